"""Tokens, candidate spans and their features for the field of ``pii``.

A batch of texts is cut into tokens (words, numbers, single signs) with numpy over code points;
words are looked up in class lists by hash.  What may be inside of a segment of a type is a set of
token classes; a *candidate* is every span of such tokens up to the type's bound of tokens that
starts and ends on whole words and has the least contents of its type:

=========  ======  ===========================================================================
email      14 + 14 tokens around an at sign, in any of its spellings; labels around it
phone      20      at least 6 digits, at most 17, in numbers and the signs that join them
id_number  16      at least 6 digits, at most 17, in numbers and groups of up to 2 letters
address    16 + 14 tokens around a street, box or way word, with a number in it
name       10      two capital items, or one after a title
=========  ======  ===========================================================================

Features look at whole spans: their signature (classes of all tokens and signs), its ends, its
counts, word lists hit, what stands on the left and right, and cue words before it.  The lists are
general vocabulary of four languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
OUTSIDE = 400_000  # characters of texts that are read at once; a longer text is read alone

# --- word classes ------------------------------------------------------------------------------

# Closed classes of words: articles, pronouns, prepositions, conjunctions, auxiliaries.
_ENGLISH = "the this that these those after before if when while as in on at for from to with without it its and or by according all any each both such where which who whose they he she we you i is are was were has have had be been being not no see there here his her their our my your per via than then also how what why during since until upon under over between among about against through within into"
_GERMAN = "der die das den dem des ein eine einer eines einem einen bei wie wenn wird für nach mit von vom und oder es er sie ihr wir ich ist sind war waren hat haben nicht aus auf an am im zum zur unter über zwischen durch gegen seit bis als auch dass daß so nur noch nun"
_FRENCH = "le la les un une des du de si pour selon comme lorsque et ou il elle ils elles nous vous je est sont était a ont dans sur sous avec sans par entre cette ce ces son sa ses leur"
_SPANISH = "el los las una unos unas según como cuando y o en por para con sin entre su sus es son fue ha han del al se lo que no"
_LISTS = {
    "func": " ".join((_ENGLISH, _GERMAN, _FRENCH, _SPANISH)),
    "calendar": "january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag janvier février mars avril juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo",
    "title": "mr mrs ms miss messrs dr prof professor herr herrn frau mme mlle monsieur madame sr sra srta señor señora don doña ing dipl sir lady dame maître me",
    "part": "van von der den zu zum zur de la del della di du da le ter ten dos vom bin ibn al",
    "der": "der den die das zu",
    "determiner": "the a an this der die das dem des den ein eine einer einem einen eines le la les un une el los las una",
    "link": "des de la du le les del los las l d bis ter quater dem den der und n nº izq dcha bajo izquierda derecha",
    "street": "street st lane ln road rd avenue ave court ct drive dr close square sq place pl row way terrace crescent boulevard blvd highway hwy parkway walk hill gardens rue av bd chemin allée impasse quai route cours passage faubourg calle c avda avenida plaza paseo pza camino ronda carretera travesía straße strasse str gasse weg platz allee",
    "lead": "am an im auf in zum zur unter beim vor hinter",
    "box": "box postfach apartado apdo bp boîte postale casilla po pob b p o",
    "unit": "flat apt apartment suite unit room floor fl ste wohnung appartement étage piso planta puerta bât building",
    "company": "gmbh ag kg ohg se ltd limited inc corp corporation llc llp plc co company companies group holding holdings sa sas sarl sl srl bv nv oy ab as werke werk labs laboratories laboratory systems devices works industries instruments partners technologies technology solutions university institute standard process method test gauge effect law ventures bank foundation society association motors electronics pharma",
    "c_phone": "tel tél telephone telefon téléphone teléfono phone fax telefax fon mobile mobil móvil cell call ring dial hotline anruf llamar appeler portable handy",
    "c_mail": "mail email e-mail courriel correo mailto mails",
    "c_id": "ssn social security insurance ni nino passport passnummer reisepass pasaporte passeport ausweis personalausweis identity id dni nie nif cif nir insee sécurité sociale seguridad steuer steuerid steuernummer identifikationsnummer identification tax tin taxpayer pièce identité documento declarant declarante sozialversicherungsnummer license licence carte cédula",
    "c_person": "inventor inventors erfinder erfinderin erfinderinnen inventeur inventeurs inventrice inventora inventores author authors autor autora auteur name nom nombre signed signature witness witnessed zeuge zeugin témoin testigo agent attorney representative vertreter vertreterin mandataire representante declaration erklärung déclaration declaración gez firmado fdo signé attn contact led dear sincerely regards made conducted supervised erklärt erklärte thanks dank remercie gracias dirigido suivi",
    "c_by": "by von par por of de durch vom",
    "c_addr": "address adresse anschrift dirección residence residing resides resident wohnhaft wohnt demeurant domicilié domicile domicilio residente located at lives live headquarters sitz premises workshop werkstatt atelier taller office büro bureau oficina site",
    "c_ref": "serial ser part order invoice batch lot docket ref reference model type figure fig table claim claims page version standard process patent application priority drawing card catalogue catalog filed art item iso din en rev clause section file case ticket sample code anspruch ansprüche revendication reivindicación lfd bestell rechnung commande facture pedido factura modèle modelo typ teil pièces port ip v ver release entry volume vol pp isbn issn doi tolerance zeichnung dessin dibujo norm ii iii iv vi vii viii ix xi xii",
    "c_owner": "applicant applicants assignee assignees licensee licensor owner proprietor anmelder anmelderin inhaber inhaberin demandeur titulaire solicitante titular opponent manufacturer hersteller fabricant fabricante firm firma société empresa supplier",
    "verb": "said says states stated noted notes confirmed confirms declares declared repeated objected explained writes wrote lives works joined reported argued claims led replied signed bestätigte bestätigt notierte erklärte erklärt sagt sagte schreibt widersprach wohnt arbeitet begleitet declara declaró confirmó anotó dijo escribe vive trabaja objetó confirme déclare dit écrit habite travaille noté confirmé déclaré contesté hereby kindly herself himself repitió wiederholte répété",
    "number": "no nr nos number numbers num numéro número nummer n",
    "at_word": "at arroba chez",
    "dot_word": "dot punto point punkt",
    "ext": "ext x poste durchwahl app int extensión extension dw nebenstelle",
    "common_given": "john mary james anna maria peter paul david michael robert william thomas sarah laura emma julia martin daniel george susan karen lisa nancy linda mark steven kevin brian alice helen rachel hans klaus jürgen wolfgang heinz karl fritz ursula monika petra sabine andrea stefan thomas andreas jean pierre marie claude françois michel jacques philippe nathalie sophie camille luc juan josé carlos luis miguel pedro carmen ana lucía elena sofía javier pablo diego lars sven erik nina eva ivan olga marco giulia luca",
}
BIT = {name: 1 << i for i, name in enumerate((*_LISTS, "given", "family", "way", "town"))}
CUES = ("c_phone", "c_mail", "c_id", "c_person", "c_by", "c_addr", "c_ref", "c_owner")
AFTER = ("verb", "company", "street")
NEUTRAL = BIT["func"] | BIT["number"]  # not counted in the distance of a cue
#: Codes before fields of bibliographic data (WIPO ST.9): inventors and attorneys; applicants and owners.
CODES = {"72": "c_person", "74": "c_person", "75": "c_person", "71": "c_owner", "73": "c_owner"}
CUE_MASK = sum(BIT[c] for c in CUES)
AFTER_MASK = sum(BIT[c] for c in AFTER)
DETERMINER, FUNC, TITLE, PART, LINK, STREET, LEAD, BOX, UNIT = (BIT[n] for n in ("determiner", "func", "title", "part", "link", "street", "lead", "box", "unit"))
COMPANY, GIVEN, FAMILY, WAY, TOWN, COMMON = (BIT[n] for n in ("company", "given", "family", "way", "town", "common_given"))
GERMAN = ("straße", "strasse", "weg", "gasse", "platz", "allee", "damm", "ring", "ufer", "berg", "hof", "graben", "markt", "steig", "str")
#: Endings of nouns and adjectives that stand for things.
THINGS = ("ung", "ungen", "heit", "keit", "schaft", "tion", "tionen", "tions", "tät", "nis", "ment", "ments", "chen", "ity", "ness", "ing", "ings", "ance", "ence", "ción", "ciones", "dad", "miento", "ture", "tures", "teil", "teile", "seite", "stück", "stücke", "weise", "gerät", "che", "liche", "sche", "ige", "bare", "ere", "nte", "rte", "ste", "ten", "ate", "ical", "able", "ique", "aire", "ies")
#: What a person's name can't have in it.
NO_NAME = BIT["func"] | BIT["calendar"] | BIT["company"] | BIT["c_owner"] | BIT["c_ref"] | BIT["c_phone"] | BIT["c_mail"] | BIT["c_id"] | BIT["unit"] | BIT["title"]


class Lexicon:
    """Known words by kind (given, family, street, town); entries of several words count word by word.
    ``classes`` maps hashes of words to class bits; it is as long as the lists and the lexicon are."""

    def __init__(self, rows: Iterable[tuple[str, str]] = ()):
        bits: dict[str, int] = {}
        for name, words in _LISTS.items():
            for w in words.split():
                bits[w] = bits.get(w, 0) | BIT[name]
        kinds = {"given": GIVEN, "family": FAMILY, "street": WAY, "town": TOWN}
        for word, kind in rows:
            if word and kind in kinds:
                for w in _WORDS(word.lower()):
                    if len(w) > 2 and not bits.get(w, 0) & (PART | LINK):
                        bits[w] = bits.get(w, 0) | kinds[kind]
        hashes = np.array([_hash(w) for w in bits], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.bits = hashes[order], np.array(list(bits.values()), np.int64)[order]


# --- tokens ------------------------------------------------------------------------------------

_POWER = np.cumprod(np.full(64, 1099511628211, np.uint64))
W_LOW, W_CAP, W_ALL, W_ONE, NUMBER, SIGN = range(6)


JOIN, COMMA, DOT, DIGITS, PLACE, AT = (1 << i for i in range(6))
_SIGNS = ((JOIN, "-‐'’"), (COMMA, ","), (DOT, "."), (DIGITS, "+＋-‐–－./()（）"), (PLACE, ",.-‐–/'’º°ª#"), (AT, "@＠"))


@cache
def _sign_table() -> np.ndarray:
    out = np.zeros(65536, np.uint8)
    for bit, signs in _SIGNS:
        for c in signs:
            out[ord(c)] |= bit
    return out


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class (0 sign, 1 small letter, 2 capital, 3 digit, 4 blank, 5 line break) and small form of every code point of the basic plane."""
    kind, small = np.zeros(65536, np.uint8), np.arange(65536, dtype=np.uint64)
    for i in range(65536):
        c = chr(i)
        cat = unicodedata.category(c)
        kind[i] = 5 if c in "\n\x0b\x0c  " else 4 if cat == "Zs" or c in "\t\r\x1c\x1d\x1e\x1f\x85" else 3 if cat == "Nd" else 2 if cat in ("Lu", "Lt") else 1 if cat[0] in "LM" else 0
        low = c.lower()
        if len(low) == 1:
            small[i] = ord(low)
    return kind, small


def _WORDS(text: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in text).split()


def _hash(word: str) -> int:
    at = np.array([ord(c) for c in word[:64]], np.uint64)
    with np.errstate(over="ignore"):
        return int((at * _POWER[: len(at)]).sum())


@dataclass
class Tokens:
    """Tokens of texts laid end to end; lists, as single elements are read often."""

    text: str
    start: list[int]
    end: list[int]
    kind: list[int]
    gap: list[int]  # before the token: 0 nothing, 1 blanks, 2 a line break, 3 an empty line or the start of a text
    bits: list[int]
    arrays: tuple[np.ndarray, ...]  # kind, gap, bits, length and class of sign, of all tokens
    borders: np.ndarray  # first token of each text, and the number of tokens


def tokens(texts: list[str], lex: Lexicon) -> tuple[Tokens, np.ndarray]:
    """Tokens of several texts, and the place at which each text starts."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    text = "\n\n".join(texts) + "\n\n"
    offsets = np.cumsum(sizes) - sizes
    kinds, small = _tables()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(code, 65535)
    c = kinds[code]
    group = np.array([4, 1, 1, 2, 3, 3], np.uint8)[c]
    new = np.r_[True, (group[1:] != group[:-1]) | (group[1:] == 4)]
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(code)])
    g = group[start]
    breaks = np.add.reduceat((c == 5).astype(np.int32), start)
    blank = g == 3
    gap_of = np.where(blank, 1 + np.minimum(breaks, 2), 0)
    keep = np.flatnonzero(~blank)
    before = np.where(keep > 0, gap_of[np.maximum(keep - 1, 0)], 3)
    first = np.searchsorted(start[keep], offsets)
    before[first[first < len(keep)]] = 3
    start_k, length_k = start[keep], length[keep]
    capital = np.add.reduceat((c == 2).astype(np.int32), start)[keep]
    gk = g[keep]
    kind = np.where(gk == 2, NUMBER, np.where(gk == 4, SIGN, np.where(c[start_k] == 1, W_LOW, np.where(length_k == 1, W_ONE, np.where(capital == length_k, W_ALL, W_CAP)))))
    bits = np.zeros(len(keep), np.int64)
    if len(keep):
        owner = np.cumsum(new) - 1
        place = np.arange(len(code)) - start[owner]
        with np.errstate(over="ignore"):
            value = np.where((group == 1) & (place < 64), small[code] * _POWER[np.minimum(place, 63)], 0).astype(np.uint64)
            h = np.add.reduceat(value, start)[keep]
        at = np.minimum(np.searchsorted(lex.hashes, h), len(lex.hashes) - 1)
        bits = np.where((gk == 1) & (lex.hashes[at] == h), lex.bits[at], 0)
    return Tokens(text, start_k.tolist(), (start_k + length_k).tolist(), kind.tolist(), before.tolist(), bits.tolist(), (kind, before, bits, length_k, np.where(kind == SIGN, _sign_table()[code[start_k]], 0)), np.r_[first, len(keep)]), offsets


# --- candidates --------------------------------------------------------------------------------


@dataclass(slots=True)
class Span:
    start: int
    end: int
    kind: str
    features: list[str]
    score: float = 0.0


def _symbol(t: Tokens, i: int) -> str:
    """Class of a token in signatures."""
    k, b = t.kind[i], t.bits[i]
    if k == NUMBER:
        return f"d{min(6, t.end[i] - t.start[i])}"
    if k == SIGN:
        return t.text[t.start[i]]
    if k != W_LOW:
        return "T" if b & TITLE else "S" if b & STREET else "B" if b & BOX and k != W_ONE else "U" if b & UNIT else "X" if b & COMPANY else "K" if b & CUE_MASK else "CAI"[k - 1]
    return "t" if b & DETERMINER else "s" if b & STREET else "f" if b & FUNC else "l" if b & (LINK | PART) else "v" if t.end[i] - t.start[i] == 1 else "w"


def _beside(t: Tokens, i: int, j: int) -> tuple[str, str]:
    """What stands on the left of token i and on the right of token j."""
    g = t.gap[i]
    left = "||" if g == 3 or i == 0 else ("", "_", "|")[g] + _symbol(t, i - 1)
    n = j + 1
    if n >= len(t.start) or t.gap[n] == 3:
        return left, "||"
    right = ("", "_", "|")[t.gap[n]] + _symbol(t, n)
    if t.kind[n] == SIGN and n + 1 < len(t.start):
        right += "||" if t.gap[n + 1] == 3 else ("", "_", "|")[t.gap[n + 1]] + _symbol(t, n + 1)
    return left, right


def _context(t: Tokens, i: int, j: int, kind: str) -> list[str]:
    left, right = _beside(t, i, j)
    out = [f"{kind}", f"{kind}:L{left}", f"{kind}:R{right}"]
    if len(right) > 2:
        out.append(f"{kind}:r{right[:2]}")
    near = far = 0
    k, words, g = i - 1, 0, t.gap[i]
    while k >= 0 and words < 5 and g < 3 and k > i - 14:
        if t.kind[k] < NUMBER:
            words += not t.bits[k] & NEUTRAL or bool(t.bits[k] & CUE_MASK)
            if words <= 2:
                near |= t.bits[k]
            else:
                far |= t.bits[k]
        elif t.text[t.start[k]] in ".;" and t.gap[k + 1] and (k == 0 or t.end[k - 1] - t.start[k - 1] > 5):
            break
        g = t.gap[k] if t.gap[k] != 2 or words else 3 if words else 2
        if t.gap[k] == 2 and words:
            break
        k -= 1
    if i > 2 and not words and not t.gap[i - 1] and not t.gap[i - 2] and t.gap[i] < 3 and t.kind[i - 2] == NUMBER and t.text[t.start[i - 1]] == ")" and t.text[t.start[i - 3]] == "(" and (code := CODES.get(t.text[t.start[i - 2] : t.end[i - 2]])):
        near |= BIT[code]
    elif i > 2 and t.kind[i - 1] < NUMBER and t.text[t.start[i - 3] : t.end[i - 1]].lower() == "c/o":
        near |= BIT["c_person"]
    if near & CUE_MASK:
        out += [f"{kind}:near_{c}" for c in CUES if near & BIT[c]]
    else:
        out.append(f"{kind}:near_none")
    if far & CUE_MASK:
        out += [f"{kind}:far_{c}" for c in CUES if far & BIT[c]]
    ahead, k = 0, j + 1
    while k < len(t.start) and k <= j + 3 and t.gap[k] < 3:
        ahead |= t.bits[k]
        k += 1
    if ahead & AFTER_MASK:
        out += [f"{kind}:after_{c}" for c in AFTER if ahead & BIT[c]]
    return out


def _signature(t: Tokens, i: int, j: int) -> str:
    out = [_symbol(t, i)]
    for k in range(i + 1, j + 1):
        out.append(("", "_", "|", "")[t.gap[k]] + _symbol(t, k))
    return "".join(out)


def _runs(ok: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [a, b) of allowed tokens without an empty line in them."""
    on = np.r_[ok, False]
    apart = np.r_[gap, 3] == 3
    before = np.r_[False, ok]
    starts = np.flatnonzero(on & (~before | apart))
    ends = np.flatnonzero(before & (~on | apart))
    return starts, ends


def _within(counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of counts over [a, b)."""
    total = np.r_[0, np.cumsum(counts)]
    return total[b] - total[a]


def _split(t: Tokens, i: int) -> bool:
    """Whether a cut before token i is within a word or number: nothing between it and a letter, digit or joining sign."""
    if i <= 0 or i >= len(t.start) or t.gap[i]:
        return False
    a, b = t.kind[i - 1], t.kind[i]
    word = lambda k, x: k < SIGN or t.text[t.start[x]] in "-‐'’_@＠"
    return word(a, i - 1) and word(b, i)


def _emails(t: Tokens) -> Iterator[Span]:
    kind, gap, bits, _, signs = t.arrays
    n = len(kind)
    inside = set("._+-%'‐")
    for at in np.flatnonzero((signs & AT != 0) | (bits & BIT["at_word"] != 0)).tolist():
        a = b = at  # the at sign with its brackets
        if t.kind[at] == SIGN:
            pass
        elif 0 < at < n - 1 and t.text[t.start[at - 1]] in "[({<" and t.text[t.start[at + 1]] in "])}>":
            a, b = at - 1, at + 1
        elif at + 3 >= n or not any(t.bits[k] & BIT["dot_word"] for k in range(at + 2, min(n, at + 5))):
            continue
        if a == 0 or b + 1 >= n or t.gap[a] > 2 or t.gap[b + 1] > 2:
            continue
        i, lefts = a - 1, []
        while i >= 0 and a - i <= 14 and (t.kind[i] < SIGN or t.text[t.start[i]] in inside):
            if t.kind[i] < SIGN:
                lefts.append(i)
            if t.gap[i]:
                break
            i -= 1
        j, rights = b + 1, []
        while j < n and j - b <= 14:
            if j > b + 1 and t.gap[j] and not (t.bits[j] & BIT["dot_word"] or t.bits[j - 1] & BIT["dot_word"] or t.text[t.start[j]] in "[({." or t.text[t.start[j - 1]] in "])}."):
                break
            if t.gap[j] > 2 or j > b + 1 and t.gap[j] > 1:
                break
            if t.kind[j] < SIGN:
                if t.kind[j] < NUMBER and j > b + 1:
                    rights.append(j)
            elif t.text[t.start[j]] not in ".．-_[](){}":
                break
            j += 1
        for i in lefts:
            for j in rights:
                mid = t.text[t.end[i] : t.start[j]]
                style = "sign" if b == a else "bracket"
                if t.kind[at] != SIGN and a == b:
                    style = "word"
                dots = "[" if any(t.text[t.start[k]] in "[({" for k in range(b + 1, j)) else "word" if any(t.bits[k] & BIT["dot_word"] for k in range(b + 1, j)) else "." if any(t.text[t.start[k]] in ".．" for k in range(b + 1, j)) else "none"
                spaced = f"{t.gap[a]}{t.gap[b + 1]}"
                loose = any(t.gap[k] for k in range(b + 2, j + 1)) and dots == "."
                f = _context(t, i, j, "email")
                f += [f"email:at={style}{spaced}", f"email:dots={dots}{'loose' * loose}", f"email:at={style},{dots}", f"email:tld{min(9, t.end[j] - t.start[j])}", f"email:labels{min(5, sum(t.kind[k] < SIGN for k in range(b + 1, j + 1)))}"]
                if _split(t, i) or (i and not t.gap[i] and t.text[t.start[i - 1]] in ".+"):
                    f.append("email:cut_left")
                if j + 2 < n and not t.gap[j + 1] and not t.gap[j + 2] and t.text[t.start[j + 1]] in ".-_" and t.kind[j + 2] < SIGN or _split(t, j + 1):
                    f.append("email:cut_right")
                if j + 2 < n and t.text[t.start[j + 1]] in "[({" and t.gap[j + 2] < 3 and t.bits[j + 2] & BIT["dot_word"] or j + 1 < n and t.gap[j + 1] == 1 and t.bits[j + 1] & BIT["dot_word"]:
                    f.append("email:cut_right")
                if any(c in mid for c in "\n"):
                    f.append("email:line")
                yield Span(t.start[i], t.end[j], "email", f)


def _numbers(t: Tokens) -> Iterator[Span]:
    """Candidates for phone and identity numbers."""
    kind, gap, bits, length, signs = t.arrays
    text, n = t.text, len(kind)
    ext_word = (bits & BIT["ext"] != 0) & (kind < NUMBER)
    ok = (kind == NUMBER) | (signs & DIGITS != 0) | (signs & (COMMA | DOT) != 0) & np.r_[ext_word[1:], False]
    ok |= (kind != SIGN) & (kind != NUMBER) & (length <= 2) & (kind != W_LOW) | ext_word
    starts, ends = _runs(ok, gap)
    enough = _within(np.where(kind == NUMBER, length, 0), starts, ends) >= 6
    for a, b in zip(starts[enough].tolist(), ends[enough].tolist()):
        for i in range(a, b):
            if t.kind[i] == SIGN and text[t.start[i]] not in "+＋(（" or _split(t, i) and t.kind[i - 1] != SIGN:
                continue
            if t.kind[i] < NUMBER and t.bits[i] & BIT["ext"] and t.kind[i] == W_LOW:
                continue
            d = letters = breaks = ext = 0
            for j in range(i, min(b, i + 20)):
                if j > i:
                    breaks += t.gap[j] == 2
                k = t.kind[j]
                if k == NUMBER:
                    d += t.end[j] - t.start[j]
                elif k < NUMBER:
                    if t.bits[j] & BIT["ext"] and d >= 6 and (k == W_LOW or t.end[j] - t.start[j] > 2):
                        ext = d
                    else:
                        letters += t.end[j] - t.start[j]
                if d > 17 + 5 * bool(ext) or breaks > 1:
                    break
                if d < 6 or k == SIGN or _split(t, j + 1) and t.kind[j + 1] != SIGN:
                    continue
                if not letters and k == NUMBER:
                    yield from _phone(t, i, j, ext or d, bool(ext))
                if not ext and j < i + 16 and text[t.start[i]] not in "+＋(（" and (k == NUMBER or t.end[j] - t.start[j] == 1) and letters <= 4:
                    yield _id(t, i, j, d, letters)


def _shape(t: Tokens, i: int, j: int) -> str:
    """Groups of digits by length, letters as A, signs and gaps as they are."""
    out = []
    for k in range(i, j + 1):
        if k > i and t.gap[k]:
            out.append("_" if t.gap[k] == 1 else "|")
        n = t.end[k] - t.start[k]
        s = t.text[t.start[k]]
        out.append(str(n) if t.kind[k] == NUMBER else ("e" if t.bits[k] & BIT["ext"] and n > 1 else "A" * n) if t.kind[k] < NUMBER else "+" if s in "+＋" else "(" if s in "(（" else ")" if s in ")）" else "-" if s in "-‐–－" else s)
    return "".join(out)


def _balanced(shape: str) -> bool:
    return shape.count("(") == shape.count(")") and (")" not in shape or shape.find("(") < shape.find(")"))


def _numbers_beside(t: Tokens, i: int, j: int) -> list[str]:
    """Whether a span could go on: digits on its left or right, directly or behind one sign or blank."""
    out = []
    n = len(t.start)
    if i and t.gap[i] < 2:
        if t.kind[i - 1] == NUMBER:
            out.append(f"L{t.gap[i]}")
        elif t.kind[i - 1] == SIGN and t.text[t.start[i - 1]] in "+＋-‐–－./()（）,@":
            out.append(f"L{t.gap[i]}" + ("+" if t.text[t.start[i - 1]] in "+＋" else "x") + str(int(i > 1 and t.kind[i - 2] == NUMBER and not t.gap[i - 1])))
        elif t.kind[i - 1] < NUMBER and not t.gap[i]:
            out.append("La")
    if j + 1 < n and t.gap[j + 1] < 2:
        if t.kind[j + 1] == NUMBER:
            out.append(f"R{t.gap[j + 1]}")
        elif t.kind[j + 1] == SIGN and t.text[t.start[j + 1]] in "-‐–－./()（）,@" and j + 2 < n and t.kind[j + 2] == NUMBER and not t.gap[j + 1] and t.gap[j + 2] < 3:
            out.append("R0x" + str(t.gap[j + 2]))
        elif t.bits[j + 1] & BIT["ext"] and j + 2 < n and t.gap[j + 2] < 3:
            out.append("Re")
        elif t.kind[j + 1] < NUMBER and t.end[j + 1] - t.start[j + 1] <= 2 and t.kind[j + 1] != W_LOW:
            out.append(f"Ra{t.gap[j + 1]}")
        elif t.kind[j + 1] == SIGN and not t.gap[j + 1] and j + 2 < n and not t.gap[j + 2] and t.text[t.start[j + 1]] in "-‐" and t.kind[j + 2] in (W_ONE, W_ALL):
            out.append("R-a")
    return out


def _phone(t: Tokens, i: int, j: int, d: int, ext: bool) -> Iterator[Span]:
    shape = _shape(t, i, j)
    head = shape.split("e")[0].rstrip("_,(") if ext else shape
    f = _context(t, i, j, "phone") + [f"phone:{x}" for x in _numbers_beside(t, i, j)]
    plus, bracket = head.startswith("+"), "(" in head
    first = t.text[t.start[i] : t.end[j]].lstrip("+＋(（ ")[:2]
    trunk = unicodedata.digit(first[0], 10) == 0
    f += [f"phone:shape={head}", f"phone:n{d}", f"phone:n{d}{'+' * plus}{'0' * trunk}", f"phone:groups{min(6, sum(t.kind[k] == NUMBER for k in range(i, j + 1)))}", f"phone:plus{int(plus)}", f"phone:trunk{int(trunk)}"]
    if bracket or ")" in head:
        f.append(f"phone:bracket{int(_balanced(head))}")
    if ext:
        f.append("phone:ext")
    if "|" in shape:
        f.append("phone:line")
    if ".." in head or "--" in head or "//" in head or "-." in head:
        f.append("phone:signs")
    seps = {c for c in head if c in "-./_"}
    f.append("phone:seps" + "".join(sorted(seps)))
    yield Span(t.start[i], t.end[j], "phone", f)


def _id(t: Tokens, i: int, j: int, d: int, letters: int) -> Span:
    shape = _shape(t, i, j)
    flat = shape.replace("_", "").replace("|", "")
    f = _context(t, i, j, "id_number") + [f"id_number:{x}" for x in _numbers_beside(t, i, j)]
    f += [f"id_number:shape={shape.replace('|', '_')}", f"id_number:flat={flat}", f"id_number:n{d}a{letters}", f"id_number:letters{min(letters, 3)}"]
    if "(" in shape or ")" in shape:
        f.append("id_number:bracket")
    if "/" in shape:
        f.append("id_number:slash")
    if "|" in shape:
        f.append("id_number:line")
    if letters and any(t.kind[k] < NUMBER and t.text[t.start[k]].islower() for k in (i, j)):
        f.append("id_number:small")
    return Span(t.start[i], t.end[j], "id_number", f)


def _particles(t: Tokens, i: int) -> int:
    """Number of particles on the left of token i."""
    n = 0
    while i - n and t.bits[i - n - 1] & PART and t.kind[i - n - 1] == W_LOW and t.gap[i - n] < 3:
        n += 1
    return n


def _titled(t: Tokens, i: int) -> bool:
    """Whether a title stands before token i, or before the particles on its left."""
    i -= _particles(t, i)
    k = i - 1
    if k < 0 or t.gap[i] == 3:
        return False
    if t.kind[k] == SIGN and t.text[t.start[k]] == "." and k and not t.gap[k]:
        k -= 1
        if t.kind[k] == W_ONE and t.text[t.start[k]] == "M":
            return True
    return bool(t.bits[k] & TITLE) and t.kind[k] not in (W_LOW, SIGN)


def _names(t: Tokens) -> Iterator[Span]:
    kind, gap, bits, length, signs = t.arrays
    text, n = t.text, len(kind)
    nextsign, nextgap = np.r_[signs[1:], 0], np.r_[gap[1:], 3]
    # single capitals before a full stop or an apostrophe, whatever words they may be elsewhere
    initial = (kind == W_ONE) & (nextgap == 0) & (nextsign & (DOT | JOIN) != 0)
    capital = ((kind == W_CAP) | (kind == W_ALL)) & ((bits & NO_NAME) == 0) | initial
    ok = capital | ((bits & PART) != 0) & ((kind == W_LOW) | (kind == W_ALL) | (kind == W_CAP) & ((bits & BIT["lead"]) == 0) & (length < 4) & (bits & BIT["der"] == 0))
    between = np.r_[False, ok[:-1]] & np.r_[ok[1:], False] & (gap == 0)
    ok = ok | (signs & JOIN != 0) & between & (nextgap == 0) | (signs & COMMA != 0) & between & (nextgap < 3) | (signs & DOT != 0) & (gap == 0) & np.r_[False, (kind == W_ONE)[:-1] & ok[:-1]]
    upper = np.r_[0, np.cumsum((kind == W_CAP) | (kind == W_ALL))]
    word = np.r_[0, np.cumsum(kind < NUMBER)]
    starts, ends = _runs(ok, gap)
    title = (bits & TITLE != 0) | (kind == W_ONE) & (nextsign & DOT != 0)
    some = _within(capital, starts, ends)
    enough = (some >= 2) | (some >= 1) & (_within(title, np.maximum(starts - 4, 0), ends) > 0)
    for a, b in zip(starts[enough].tolist(), ends[enough].tolist()):
        titles = {k - back for k in range(a, b) if capital[k] and _titled(t, k) for back in range(_particles(t, k) + 1)}
        if not titles and sum(capital[a:b].tolist()) < 2:
            continue
        own = int(np.searchsorted(t.borders, a, "right"))
        lo, hi = max(t.borders[own - 1], a - 40), min(t.borders[own], b + 40)
        rate = (upper[hi] - upper[lo] - (upper[b] - upper[a])) / max(1, word[hi] - word[lo] - (word[b] - word[a]))
        rare = "rare" if rate < 0.1 else "some" if rate < 0.22 else "many"
        for i in range(a, b):
            if t.kind[i] == SIGN or _split(t, i):
                continue
            for j in range(i, min(b, i + 10)):
                if t.kind[j] == W_LOW or _split(t, j + 1):
                    continue
                if t.kind[j] == SIGN and (text[t.start[j]] != "." or t.kind[j - 1] != W_ONE or j == i):
                    continue
                f = _name(t, i, j, i in titles, rare)
                if f:
                    yield Span(t.start[i], t.end[j], "name", f)


def _name(t: Tokens, i: int, j: int, titled: bool, rare: str) -> list[str] | None:
    items: list[str] = []  # C word, A word in capitals, I initial, p particle, comma
    heads: list[int] = []  # bits of each item
    breaks = 0
    k = i
    while k <= j:
        if k > i and t.gap[k] == 2:
            breaks += 1
            items.append("|")
            heads.append(0)
        kind, b = t.kind[k], t.bits[k]
        if kind == SIGN:
            if t.text[t.start[k]] == ",":
                items.append(",")
                heads.append(0)
            k += 1
            continue
        last = k
        while last + 2 <= j and t.kind[last + 1] == SIGN and t.text[t.start[last + 1]] in "-‐'’" and not t.gap[last + 1] and not t.gap[last + 2]:
            last += 2
            b |= t.bits[last]
        if last > k:
            items.append("A" if all(t.kind[x] in (W_ALL, W_ONE, SIGN) for x in range(k, last + 1)) else "C")
        elif kind == W_LOW or b & PART and kind != W_ONE and k < j and items[-1:] != [","]:
            items.append("p" if kind == W_LOW else "P")
        else:
            items.append("a" if kind == W_ALL and t.end[k] - t.start[k] == 2 else {W_CAP: "C", W_ALL: "A", W_ONE: "I"}[kind])
        heads.append(b)
        k = last + 1
    if t.kind[j] != SIGN and t.bits[j] & PART and t.bits[j] & FUNC or items[-1] in "pP" or items[0] == "," or items[0] == "p" and not titled and "," not in items:
        return None  # a particle is not the end of a name, and its start only in a family name
    words = [x for x in items if x in "CAIa"]
    if len([x for x in words if x != "I"]) < 1 or items.count(",") > 1 or len(words) < 2 and not titled or breaks > 1:
        return None
    sig = "".join(items)
    f = _context(t, i, j, "name")
    near = [x for x in f if x.startswith("name:near_")]
    f += [f"{near[0]}:{f[1][5:]}", f"{near[0]}:{rare}"]
    f += [f"name:sig={sig}", f"name:n{len(words)}", f"name:{rare}", f"name:{rare}:{sig[:1]}{sig[-1:]}"]
    if breaks:
        heads = [x for x, it in zip(heads, items) if it != "|"]
        items = [x for x in items if x != "|"]
    comma = items.index(",") if "," in items else 0
    big = [x for x, it in zip(heads, items) if it in "CAa"]
    at = [x for x in range(i, j + 1) if t.kind[x] in (W_CAP, W_ALL)]
    first, last = (t.text[t.start[x] : t.end[x]].lower() for x in (at[0], at[-1]))
    if len(at) > 1 and first == last:
        return None  # a word said twice
    given, family = (heads[comma + 1], heads[comma - 1]) if comma and comma + 1 < len(heads) else (heads[0], heads[-1])
    g = "lex" if given & GIVEN else "common" if given & COMMON else "none"
    fam = "lex" if family & FAMILY else "none"
    f += [f"name:given_{g}", f"name:family_{fam}", f"name:{g}:{fam}", f"name:{'comma' if comma else 'plain'}:{g}:{fam}"]
    known = f"{g}:{fam}"
    if g == "none" and not titled:
        f.append(f"name:{rare}:first_{first[-1]}")
    things = "xy"[fam == "none" and last.endswith(THINGS)] + "xy"[g == "none" and first.endswith(THINGS)]
    if things != "xx":
        f += [f"name:things_{things}", f"name:things_{things}:{rare}", f"name:things:{near[0][5:]}"]
    left = f[1].split(":", 1)[1]
    f += [f"name:{known}:{left}", f"name:{known}:{f[2][5:]}", f"name:{sig[:1]}{sig[-1:]}:{left}"]
    f += [f"name:{known}:{x[5:]}" for x in f if x.startswith(("name:near_", "name:after_"))]
    if comma == 0 and heads[0] & FAMILY and not heads[0] & GIVEN or comma and given & FAMILY and not given & GIVEN:
        f.append("name:wrong_given")
    if any(x & (TOWN | WAY) and not x & (GIVEN | FAMILY) for x in big):
        f.append("name:place")
    if any(x & STREET for x in big):
        f.append("name:street")
    if any(x & CUE_MASK for x in heads):
        f.append("name:cue_inside")
    if any(x & (BOX | LEAD) for x in big):
        f.append("name:box")
    f += [f"name:{known}:{rare}", f"name:{known}:{rare}:{near[0][5:]}"]
    if titled:
        m = "M" if i > 1 and t.kind[i - 2] == W_ONE else ""
        f += [f"name:titled{m}", f"name:titled{m}{len(words)}", f"name:titled{m}:{fam}"]
    if breaks:
        f += ["name:line", f"name:line:{g}:{fam}"]
    if any(t.gap[x] == 1 and t.start[x] - t.end[x - 1] > 2 for x in range(i + 1, j + 1)):
        f.append("name:wide")
    cases = {x.upper() for x in items if x in "CAa"}
    if len(cases) == 2 and not comma:
        f.append("name:mixed_case")
    return f


def _addresses(t: Tokens) -> Iterator[Span]:
    kind, gap, bits, length, signs = t.arrays
    text, n = t.text, len(kind)
    short = (kind == W_ONE) | (kind == W_ALL) & (length == 2)
    ok = (kind != W_LOW) & (kind != SIGN) & (short | ((bits & (FUNC | BIT["c_phone"] | BIT["c_mail"] | BIT["c_id"] | BIT["c_owner"])) == 0)) | ((bits & (LINK | STREET | LEAD | UNIT)) != 0) | (bits & BOX != 0)
    ok |= (kind == W_LOW) & (length == 1) | (signs & PLACE != 0)
    number = kind == NUMBER
    anchor = (bits & STREET != 0) & ((kind != W_LOW) | np.r_[False, number[:-1] | (kind[:-1] == SIGN)] | np.r_[False, False, number[:-2]] | np.r_[False, bits[:-1] & LINK != 0]) | (bits & BOX != 0) & (kind != W_LOW) & (length > 1) | (bits & BOX != 0) & (length > 2)
    apart = np.r_[gap[1:], 3, 3] == 3
    after = np.r_[number[1:], False] & ~apart[:-1]
    after2 = np.r_[number[2:], False, False][:n] & ~apart[:-1] & ~apart[1:]
    lead = (bits & LEAD != 0) & ((kind == W_CAP) | (kind == W_ALL)) & (after2 | np.r_[number[3:], False, False, False])
    anchor |= lead
    long = ((kind == W_CAP) | (kind == W_ALL)) & (length > 4)
    for k in np.flatnonzero(long & after).tolist():
        if text[t.start[k] : t.end[k]].lower().endswith(GERMAN):
            anchor[k] = True
    for k in np.flatnonzero(long & after2).tolist():
        if text[t.start[k + 1]] == "." and text[t.start[k] : t.end[k]].lower().endswith("str"):
            anchor[k] = True
    for k in np.flatnonzero((kind == W_ONE) & (bits & BOX != 0)).tolist():
        if text[t.start[k] : t.start[k] + 4] in ("B.P.", "P.O."):
            anchor[k] = True
    has_number = np.r_[0, np.cumsum(number)].tolist()
    starts, ends = _runs(ok, gap)
    enough = (_within(number, starts, ends) > 0) & (_within(anchor, starts, ends) > 0)
    for a, b in zip(starts[enough].tolist(), ends[enough].tolist()):
        marks = [k for k in range(a, b) if anchor[k]]
        done: set[tuple[int, int]] = set()
        for m in marks:
            for i in range(m, max(a, m - 16) - 1, -1):
                if t.kind[i] == SIGN or _split(t, i) or t.kind[i] == W_LOW and not t.bits[i] & (STREET | UNIT | LEAD):
                    continue
                if i < m and sum(t.gap[x] == 2 for x in range(i + 1, m + 1)) > 1:
                    break
                breaks = 0
                for j in range(i, min(b, m + 14)):
                    if j > i:
                        breaks += t.gap[j] == 2
                    if breaks > 2:
                        break
                    if j < m or j == i or t.kind[j] == SIGN or t.kind[j] == W_LOW and t.end[j] - t.start[j] > 1 or _split(t, j + 1):
                        continue
                    if has_number[j + 1] == has_number[i] or (i, j) in done or t.bits[j] & (STREET | UNIT) and t.kind[j] != W_ONE:
                        continue  # a street or a unit is not the end of an address
                    done.add((i, j))
                    yield Span(t.start[i], t.end[j], "address", _address(t, i, j, anchor, lead))


def _address(t: Tokens, i: int, j: int, anchor: np.ndarray, lead: np.ndarray) -> list[str]:
    sig: list[str] = []
    lex = breaks = commas = 0
    for k in range(i, j + 1):
        b, kind = t.bits[k], t.kind[k]
        n = t.end[k] - t.start[k]
        if k > i and t.gap[k] == 2:
            breaks += 1
            sig.append("|")
        if kind == NUMBER:
            sig.append("9" if n < 4 else "4" if n == 4 else "5" if n == 5 else "8")
        elif kind == SIGN:
            s = t.text[t.start[k]]
            if s == ",":
                commas += 1
            if s in ",/-–‐º°ª#":
                sig.append("-" if s in "-–‐" else "o" if s in "º°ª" else s)
        else:
            lex |= b & (WAY | TOWN)
            if lead[k]:
                s = "M"
            elif b & STREET and (kind != W_ONE or k + 1 <= j and t.text[t.start[k + 1]] == "/"):
                s = "S"
            elif b & BOX and (n > 1 or anchor[k]):
                s = "B"
            elif anchor[k]:
                s = "G"
            elif b & UNIT:
                s = "U"
            elif kind == W_LOW:
                s = "l" if b & LINK else "v"
            elif kind == W_ONE or kind == W_ALL and n <= 2:
                s = "i" if kind == W_ONE else "a"
            else:
                s = "W"
            if not (s in "WlB" and sig and sig[-1] == s):
                sig.append(s)
    full = "".join(sig)
    f = _context(t, i, j, "address")
    left, right = _beside(t, i, j)
    f += [f"address:sig={full.replace('|', ',')}", f"address:first={full[:2]}", f"address:head={full[:3]}", f"address:last={full[-2:]}", f"address:tail={full[-3:]}", f"address:{left}>{full[:1]}", f"address:{full[-1:]}>{right[:2]}", f"address:{full[-2:]}>{right[:2]}"]
    f += [f"address:way{int(bool(lex & WAY))}", f"address:town{int(bool(lex & TOWN))}", f"address:breaks{breaks}"]
    if t.bits[j] & TOWN:
        f.append("address:ends_town")
    if t.bits[j] & TOWN == 0 and j + 1 < len(t.start) and t.gap[j + 1] < 3 and t.bits[j + 1] & TOWN:
        f.append("address:town_next")
    post = sum(x in "458" for x in sig)
    f.append(f"address:post{post}")
    kinds = {x for x in full if x in "MSGBU"}
    f.append("address:has" + "".join(sorted(kinds)))
    if len(full) > 12:
        f.append("address:long")
    if any(t.bits[x] & COMPANY for x in range(i, j + 1)):
        f.append("address:company")
    if any(t.bits[x] & (BIT["c_ref"] | BIT["calendar"]) and t.kind[x] != W_LOW and not t.bits[x] & (STREET | LEAD) for x in range(i, j + 1)):
        f.append("address:ref")
    words = [x for x in range(i, j + 1) if t.kind[x] in (W_CAP, W_ALL)]
    if any(t.bits[x] & FUNC and not t.bits[x] & LEAD for x in words):
        f.append("address:func")
    if "|" in full:
        tail = full.rsplit("|", 1)[1]
        f.append(f"address:line_then={tail[:2]}")
    last = full.rfind("W")
    run = 0
    k = j
    while k >= i and t.kind[k] in (W_CAP, W_ALL):
        run += 1
        k -= 1
    f.append(f"address:town_words{min(run, 4)}")
    if last < 0:
        f.append("address:no_word")
    return f


def candidates(t: Tokens) -> list[Span]:
    """All candidates of a batch of texts, in order of their starts."""
    if len(t.start) < 2:
        return []
    out = [*_emails(t), *_numbers(t), *_names(t), *_addresses(t)]
    out.sort(key=lambda s: (s.start, s.end))
    return out
