"""Training of the span field: generated labelled texts and weights of greatest likelihood.

The sample is bounded: ``SENTENCES`` texts of a few sentences from a fixed seed, made of the templates
below in four languages, of invented names, places and addresses (two in five of them in the lexicon
that training sees), of numbers in national formats, and of things that look alike but are no
personal information.  Curly fields mark spans and their kinds; fields in square brackets are filled
but not marked.  Templates, names and words were made up for training, none is taken from a corpus.

The objective is the log-likelihood of the labelled segmentations with a quadratic penalty.  The sums
over all segmentations and the expected features come from the forward and backward recursions over
candidate spans; steps are Adam's.

``held_out`` texts have other templates, names, towns and streets than training; ``accuracy`` measures on them.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np

from .pii import REACH, decode, transition
from .pii_spans import Lexicon, Span, candidates, tokens

SENTENCES, EPOCHS, SEED, RATE, PENALTY, BATCH = 11000, 40, 20, 0.05, 3e-5, 60_000

# --- invented words ------------------------------------------------------------------------------

_HEADS = "Mir Tob An Ser Kel Jan Lud Per Is Wen Cor Hal Bri Dor Es Fal Gar Hol Ev Pel Tar Um Zan Vik Ros Ste Bor Cle Ad Lin É Ö Ø Ç Ma Sa Ni Re Ta".split()
_MIDS = "a e i o ar el in or an u ia ei ou ö é ä i".split()
_GIVEN_ENDS = "la brik vel fin dra nis ne rin ra lin na dis ta mon lo ko bert wyn sa as".split()
_FAMILY_ENDS = "vale holt rix sen feld lowe mond vane rin rath sen bridge kohl mann son ez ski etti ier aud dahl strup marsh worth ov".split()
_TOWN_ENDS = "ford denby ulm heim hausen ville mont stadt ton wick ach ona reuth court more sund val".split()
_WAY_ENDS = "brook grove lea hof tal crest mead thorn ried marsh bank wood linde stone".split()


def _made(r: random.Random, ends: list[str]) -> str:
    return r.choice(_HEADS) + r.choice(_MIDS) * (r.random() < 0.7) + r.choice("lrnmstdvkb") * (r.random() < 0.4) + r.choice(ends)


class World:
    """Invented names and places; ``lexicon`` knows two in five of them."""

    def __init__(self, seed: int, n: int = 60):
        r = random.Random(seed)
        many = lambda ends: [_made(r, ends) for _ in range(n)]
        self.given, self.family, self.town, self.way = many(_GIVEN_ENDS), many(_FAMILY_ENDS), many(_TOWN_ENDS), many(_WAY_ENDS)
        for i in range(4, n, 12):
            self.family[i] = r.choice(["van", "de", "von", "da", "de la", "van der"]) + " " + self.family[i]
        for i in range(0, n, 6):
            self.given[i] += "-" + r.choice(self.given[1::6])
            self.family[i] = r.choice(["van", "de", "von", "di", "del"]) + " " + self.family[i]
            self.family[i + 1] += "-" + r.choice(self.family[2::6])
            self.family[i + 2] = r.choice(["O'", "D'", "O’"]) + self.family[i + 2]
            self.family[i + 3] = r.choice("Stone Marsh Reed Field Wood Amber Hill Baker Klein Roth Leroy Blanco".split())
            self.given[i + 1] = r.choice("Reed Amber Ruby Dawn Felix Rose Victor Max Clara Rosa".split())
            self.town[i] = r.choice(["Port", "Saint", "Bad", "New", "Villa", "San"]) + " " + self.town[i]
            self.town[i + 1] = r.choice(["Saint", "Sankt", "Sainte"]) + "-" + self.town[i + 1]
            self.way[i] = r.choice(["Old", "Hollow", "High", "Upper", "Green"]) + " " + self.way[i]
        self.company = many(_FAMILY_ENDS)
        self.lexicon = Lexicon([(w, k) for k, ws in (("given", self.given), ("family", self.family), ("street", self.way), ("town", self.town)) for i, w in enumerate(ws) if i % 5 < 2])
        self.r = r


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


#: Everyday and technical words that are written with a capital letter in headings, at the start of sentences or, in German, always.
NOUNS_DE = "Pumpe Ventil Feder Motor Antrieb Behälter Kolben Schraube Klappe Steuerung Leitung Halterung Führung Heizung Kühlung Bremse Welle Lager Messung Probe Versuch Lösung Anlage Vorrichtung Gerät Rahmen Gehäuse Stück Träger Düse Seite Linse Prüfung Maschine Fahrzeug Netz Sensor Bild Wand Rohr".split()
ADJECTIVES_DE = "Neue Alte Kleine Große Erste Zweite Elektrische Optische Hydraulische Weitere Andere Bekannte Übliche Frühere Spätere Geeignete Dünne Harte Schnelle Beide Technische Innere Äußere Mehrere".split()
VERBS_DE = "Öffnet Schließt Bewegt Dreht Fällt Steigt Bleibt Liegt Zeigt Greift Hebt Senkt Wirkt Bricht Läuft".split()
NOUNS_EN = "Pump Valve Spring Motor Drive Tank Piston Screw Flap Control Line Bracket Guide Heater Cooler Brake Shaft Bearing Test Sample Device Frame Housing Lens Machine Vehicle Sensor Image Wall Pipe Handle Filter Plate Bench".split()
ADJECTIVES_EN = "New Old Small Large First Second Electric Optical Hydraulic Further Other Known Early Later Thin Hard Fast Inner Outer Technical".split()
HEADINGS = "SUMMARY BACKGROUND INTRODUCTION DRAWINGS FIELD OVERVIEW ÜBERSICHT EINLEITUNG AUFGABE ZEICHNUNGEN RÉSUMÉ DESSINS DOMAINE APERÇU ÍNDICE DIBUJOS CAMPO SUMARIO CONTENTS NOTES ANNEX EXAMPLES".split()

_MASK = re.compile("[#@]")


def _mask(r: random.Random, form: str) -> str:
    """``#`` a digit, ``@`` a capital letter."""
    return _MASK.sub(lambda m: r.choice("0123456789") if m[0] == "#" else r.choice("ABCDEGHJKLMNPRSTXYZ"), form)


PHONES = (
    "+49 30 ########", "+49 30 #####-###", "+49 (0)30 #####-###", "030 #####-##", "030/########", "030 ##### ###", "+49 89 ######", "0171 #######", "+49-30-########", "0049 30 ########", "(030) ########", "+49 (0) 40 #######",
    "+44 20 #### ####", "020 #### ####", "+44 (0)20 #### ####", "(020) #### ####", "01### ######", "+44 1### ######", "07### ######", "+44(0)20########",
    "###-###-####", "(###) ###-####", "###.###.####", "+1 ### ### ####", "+1 (###) ###-####", "1 ### ### ####", "1-###-###-####", "+1-###-###-####", "+1###### ####", "### ### ####", "+1##########", "+1.###.###.####",
    "+33 1 ## ## ## ##", "01 ## ## ## ##", "01.##.##.##.##", "+33(0)1## ######", "+33 (0)1 ## ## ## ##", "06-##-##-##-##", "+33 6########", "01########", "0033 1 ## ## ## ##",
    "+34 9## ## ## ##", "9## ### ###", "9##-###-###", "+34 ### ### ###", "9## ## ## ##", "+34-9########", "5## ### ###", "5##-###-###", "+34 5## ## ## ##", "+39 06 #### ####", "+41 44 ### ## ##", "+31 20 ### ####", "+43 1 #######",
)
IDS = (
    "###-##-####", "### ## ####", "###-##-####", "@@ ## ## ## @", "@@######@", "@@ ## ## ## @", "## ### ### ###", "###########", "@########", "@####@####", "@@#######", "#########", "########@", "##.###.###-@", "########-@", "@#######@", "@-#######-@", "@#######-@", "@#########",
    "# ## ## ## ### ###", "# ## ## ## ### ### ##", "# ## ## ### ### ## ##", "#############", "###############", "##.###.###@", "## ###### @ ###",
)


def _fill(kind: str, r: random.Random, w: World) -> str:
    given, family, town, way = (r.choice(x) for x in (w.given, w.family, w.town, w.way))
    if kind == "name":
        second = r.choice(w.given)
        initial = f"{given[0]}."
        middle = r.choice("ABCDEFGHIJKLMOPRSTUVWY") + "."
        return r.choices(
            [f"{given} {family}", f"{given} {middle} {family}", f"{family.upper()}, {given}", f"{family}, {given}", f"{given.upper()} {family.upper()}", f"{initial} {family}", f"{initial} {middle} {family}", f"{initial}{middle} {family}", f"{family}, {initial}", f"{family}, {initial} {middle}", f"{given} {family.upper()}", f"{family}, {given} {middle}", f"{given} {second} {family}", f"{family.upper()}, {given.upper()}", f"{family.upper()}, {initial}", f"{given}\n{family}", f"{given}  {family}"],
            [9, 4, 4, 5, 3, 5, 1, 1, 2, 1, 1, 1, 1, 1, 1, 1, 1],
        )[0]
    if kind == "email":
        g, f = (re.sub(r"[^a-z]", "", x.lower()) or "ab" for x in (given, family))
        domain = r.choice(["mail.{}.org", "{}.example", "office.{}.net", "{}.com", "lab-{}.{}.org", "post.{}.de", "{}.fr", "ip.{}.es"]).format(*(_made(r, _TOWN_ENDS).lower().encode("ascii", "ignore").decode() or "net" if i else str(r.randint(1, 99)) if r.random() < 0.2 else f[:6] for i in range(2)))
        local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}_{g}", f"{g}{r.randint(1, 99)}", f"{f}+{g[:2]}", f"info.{f}", f"{g}-{f}", f"{g[0]}.{f}"])
        dotted = domain.replace(".", r.choice(["[dot]", " [dot] ", "(dot)", " (dot) ", " dot "]))
        out = r.choices([f"{local}@{domain}", f"{local} (at) {domain}", f"{local} @ {domain}", f"{local}[at]{dotted}", f"{local} [at] {dotted}", f"{local} at {dotted if ' dot ' in dotted else domain.replace('.', ' dot ')}", f"{local}＠{domain}", f"{local}(at){domain}", f"{local} [at] {domain}"], [12, 3, 3, 3, 2, 2, 2, 1, 1])[0]
        return out.upper() if r.random() < 0.12 else out
    if kind == "phone":
        out = _mask(r, r.choice(PHONES))
        if r.random() < 0.14:
            out += r.choice([" ext. ", " ext ", " x", ", ext. ", " poste ", " Durchwahl ", " App. ", " extensión "]) + _digits(r, r.randint(1, 4))
        if r.random() < 0.05:
            out = out.translate({48 + i: 0xFF10 + i for i in range(10)} | {43: 0xFF0B, 40: 0xFF08, 41: 0xFF09})
        if r.random() < 0.04:
            out = out.replace(" ", "\n" if r.random() < 0.4 else " ", 1)
        if r.random() < 0.04:
            out = out.replace("-", "–").replace(" ", "  ", 1)
        return out
    if kind == "id":
        out = _mask(r, r.choice(IDS))
        if r.random() < 0.05:
            out = out.replace(" ", "  ", 1)
        return out
    n, code, big = str(r.randint(1, 260)), _digits(r, 5), r.random() < 0.1
    sep = r.choice([", "] * 5 + ["\n", " "])
    st = r.choice("Street St. Lane Road Rd. Avenue Ave. Court Drive Close Square Way Terrace Crescent Boulevard Blvd. Place".split())
    unit = r.choice(["Flat", "Apt.", "Apartment", "Suite", "Unit"]) + f" {r.randint(1, 40)}"
    uk = _mask(r, r.choice(["@@## #@@", "@# #@@", "@@# #@@", "@## #@@"]))
    if kind == "address":
        span = f"{n}-{int(n) + 2}" if r.random() < 0.25 else n + r.choice(["", "", "", "a", "B"])
        out = r.choice([f"{span} {way} {st}{sep}{town} {code}", f"{span} {way} {st}{sep}{town}, {uk}", f"{unit}, {n} {way} {st}, {town}", f"{n} {way} {st}, {unit}, {town}", f"{n} {way} {st}, {town}", f"{unit}, {n} {way} {st}{sep}{town} {code}", f"P.O. Box {n}{sep}{town} {code}", f"PO Box {n}, {town} {code}", f"{n}, {way} {st}, {town}, {uk}", f"{n} {way} {st}{sep}{town}, {r.choice(['OR', 'TX', 'NY'])} {code}", f"P.O. Box {n}{_digits(r, 1)}, {town}", f"{n} {way} {st}, {unit}{sep}{town} {code}", f"{n} {way} {st}, {town} {code}-{_digits(r, 4)}"])
    elif kind == "anschrift":
        suffix = r.choice(["straße", "weg", "gasse", "platz", "allee", "straße", "str.", "damm"])
        stem = way.replace(" ", "")
        no = n + r.choice(["", "", "a", "b", " c"])
        out = r.choice([f"{stem}{suffix} {no}{sep}{code} {town}", f"Am {stem}berg {no}{sep}{code} {town}", f"An der {stem} {no}{sep}{code} {town}", f"Im {stem}tal {no}{sep}{code} {town}", f"Postfach {n} {_digits(r, 2)}{sep}{code} {town}", f"{stem}{suffix} {no}, D-{code} {town}", f"Zum {stem} {no}{sep}{code} {town}", f"{stem}er Straße {no}{sep}{code} {town}", f"{stem}{suffix}  {no}{sep}{code} {town}"])
    elif kind == "adresse":
        join = r.choice(["des ", "de la ", "du ", "de ", "", "de l'"])
        out = r.choice([f"{n}, rue {join}{way}{sep}{code} {town}", f"{n} bis, rue {join}{way}{sep}{code} {town}", f"{n} bis avenue {join}{way}{sep}{code} {town}", f"{n} avenue {join}{way}{sep}{code} {town}", f"{n} ter boulevard {join}{way}{sep}{code} {town}", f"{n}, place {join}{way}{sep}{code} {town}", f"{n} quai {join}{way}{sep}{code} {town}", f"{n}, allée {join}{way}{sep}{code} {town}", f"B.P. {n}{sep}{code} {town}", f"BP {n}{sep}{code} {town}", f"{n}, chemin {join}{way}{sep}F-{code} {town}"])
    else:
        join = r.choice(["", "", "de ", "de la ", "del "])
        way_ = r.choice(["C/", "Calle", "Avda.", "Avenida", "Plaza", "Paseo", "Calle", "Camino"])
        extra = r.choice(["", "", f", {r.randint(1, 9)}º {r.choice('ABCD')}", f", {r.randint(1, 9)}º", f", {r.randint(1, 9)}.º izq."])
        comma = r.choice([", ", " ", ", "])
        out = r.choice([f"{way_} {join}{way}{comma}{n}{extra}{sep}{code} {town}", f"{way_} {join}{way}{comma}nº {n}{extra}{sep}{code} {town}", f"Apartado {n}{sep}{code} {town}", f"Apdo. de Correos {n}{sep}{code} {town}", f"{way_} {join}{way}{comma}{n}{sep}{code} {town}"])
    if r.random() < 0.06:
        out = out.replace(" ", r.choice(["\n", "  "]), 1)
    return out.upper() if big else out


_KIND = {"title": "name", "id": "id_number", "anschrift": "address", "adresse": "address", "direccion": "address"}

# --- templates: wording of their own; a field in curly brackets is a labelled span ---------------

TEMPLATES = (
    # names
    "Inventors: {name}; {name}; {name}\n", "Inventor: {name}\n", "Inventor(s): {name} / {name}\n", "Inventor(s): {name}\n", "Author: {name}\n", "Authors: {name}, {name} and {name}\n", "Erfinder: {name}\n", "Erfinder: {name} / {name}\n", "Erfinderin: {name}\n", "Inventeur(s) : {name}\n", "Inventeurs : {name} et {name}\n", "Auteur : {name}\n", "Inventora: {name}\n", "Inventores: {name}; {name}\n", "Autor: {name}\n", "Name: {name}\n", "Nom : {name}\n", "Nombre: {name}\n", "Attorney: {name}\n", "Agent: {name}\n", "Vertreter: {name}\n", "Mandataire : {name}\n", "Representante: {name}\n",
    "The measurements were made by {name} on Monday. ", "Signed, {name}\n", "signed: {name}. ", "(signed: {name}) ", "c/o {name}\n", "c/o {name}, {address}. ", "Attn: {name}\n", "The first draft came from {name}. ", "We thank {name} for advice on the figures. ", "Our gratitude goes to {name} for the pictures. ", "the witness {name} stated that nothing moved. ", "A witness, {name}, said so under oath. ", "The owner's witness, {name}, denied this. ", "{name} lives near the river with a dog. ", "{name} joined the firm in May. ", "{name} and {name} work in the same room. ", "In a letter, {name} explained the fault. ", "Yesterday {name} called twice. ", "It was {name} who found the leak. ", "I, {name}, declare as follows. ", "the undersigned {name} swears that it holds. ", "Evidence of {name} was heard. ", "The notebook of {name} was lost. ", "With {name} away, work stopped. ", "after a proposal from {name} which nobody printed. ", "a remark by {name} was kept. ",
    "Die Messung machte {name} am Montag. ", "Die Zeugin {name} bestätigte das. ", "Unser Dank gilt {name} für die Bilder. ", "Das Gutachten von {name} liegt vor. ", "Der Aufbau stammt von {name}. ", "Die Anlage wurde von {name} gewartet. ", "Ich, {name}, erkläre hiermit, dass es stimmt. ", "An Eides statt versichert {name}, dass nichts fehlt. ", "gez. {name}\n", "z. Hd. {name}\n", "{name} wohnt am Fluss. ", "{name} und {name} arbeiten hier. ", "Laut {name} war der Tank leer. ",
    "La mesure fut faite par {name} lundi. ", "Le témoin {name} a confirmé ce point. ", "Merci à {name} pour les photos. ", "L'idée vient de {name}, sans suite. ", "Je soussigné {name} déclare que tout est vrai. ", "signé {name}\n", "{name} habite près du fleuve. ", "Selon {name}, le réservoir fuyait. ", "Le montage fut surveillé par {name}. ",
    "La medida fue hecha por {name} el lunes. ", "El testigo {name} lo confirmó. ", "Gracias a {name} por las fotos. ", "La idea es de {name}, sin más. ", "Yo, {name}, declaro que es cierto. ", "firmado: {name}\n", "fdo. {name}\n", "{name} vive cerca del río. ", "Según {name}, no había fugas. ", "La prueba la dirigió {name} en abril. ",
    "Mr {title} opened the valve. ", "Ms. {title} left early. ", "Dr. {title} checked the scale again. ", "Prof. {title} gave a talk. ", "Mrs {title} objected to that. ", "Herr {title} war dabei. ", "Frau {title} verneinte das. ", "Herrn Dr. {title} ist das neu. ", "M. {title} a quitté la salle. ", "M. {title} conteste ce point. ", "M. {title} a répondu que non. ", "Selon M. {title}, c'est faux. ", "M. {title} n'a rien vu. ", "Mme {title} a refusé. ", "Sr. {title} salió antes. ", "La Sra. {title} no lo vio. ", "Señor {title} llegó tarde. ", "Dr. {name} was there. ", "Herr {name} kam später. ", "Prof. Dr. {title} sprach zuerst. ", "Mme {name} est arrivée. ",
    "Dear {name},\n", "Regards,\n{name}\n", "{name}\n{address}\n", "{name}\n{address}\nTel. {phone}\n", "{name}\n{anschrift}\nTel. {phone}\n", "{name}\n{adresse}\nTél. {phone}\n", "{name}\n{direccion}\nTel. {phone}\n", "{name}, {anschrift}. ", "{name}\n{address}\n{email}\n", "{name} <{email}>\n", "{name} <{email}> ", "{name} ({email}) ", "Statement of {name} (ID {id}). ", "Aussage von {name} (Ausweis {id}). ", "Attestation de {name} (pièce {id}). ", "Testimonio de {name} (documento {id}). ", "{name}, DNI {id}, ", "Present: {name}, {name}, {name}.\n", "{name}; {name}; {name}.\n", "Team: {name} & {name}\n", "{name}; {name}; {name}. The pump works. ", "Present were {name}, {name}, {name}. ", "Anwesend: {name}; {name}; {name}. Die Pumpe lief. ", "{name}, {name}, {name}. El tanque es viejo. ", "Étaient là {name} ; {name} ; {name}. ", "drawn by {name} and kept. ", "a drawing by {name} that was lost. ", "gezeichnet von {name} und verwahrt. ", "dessiné par {name} et perdu. ", "{name}\n{address}\n", "{name}\n{anschrift}\n", "{name} states that it holds. ", "{name} says it moved. ", "{name}, {name}, {name}\n", "Inventors: {name}, {name}, {name}. ", "Erfinder: {name}, {name}, {name}, {name}\n", "{name} <{email}>\n", "by {name} <{email}>; ", "suivi par {name}. ", "fait par {name}\n", "hecho por {name}\n", "{name} <{email}>", "(72) {name}. ", "(72) {name}\n", "(72) {name}; {name}\n", "{name}\n[heading]\n", "Inventor(s): {name}\n[heading]\nThe pump turns. ", "Erfinder: {name}\n[heading]\n", "by {name}\n[heading]\n", "Inventeur : {name} \n[heading]\n", "(74) {name}, [town]. ", "(71) [company] Ltd (72) {name} ", "Erklärung von {name}, ", "Declaración de {name}. ", "Une note de {name} existe. ", "un plano de {name} que nadie vio. ", "gez. {name}. ", "signed {name}; ", "(inventor: {name}) ",
    "The paper by {name} is short. ", "Talk with {name}, later. ", "Notes of {name} and {name}\n", "the team of {name} won. ", "so said {name}, who left. ", "as {name} wrote, it holds. ", "{name} paid. ", "Then {name} came back with tea. ", "Here {name} stopped. ", "see {name} about this. ", "{name}: yes, it moved. ", "ask {name} or {name}. ", "Mein Kollege {name} kam. ", "Die Prüferin {name} fand nichts. ", "Gutachter {name} lehnte ab. ", "Bericht: {name}\n", "Chef de projet : {name}\n", "le docteur {name} a vu la cuve. ", "La profesora {name} habló. ", "el técnico {name} midió. ", "from {name} to {name}, in haste. ", "editor: {name}; printer: {name}. ", "Written by {name}.\n", "Best wishes,\n{name}\n", "Head: {name}\n", "with {name} at the wheel. ",
    # numbers within sentences and without a cue
    "at {phone} until six. ", "under the number {phone}. ", "my new number, {phone}, works. ", "Nummer {phone}. ", "numéro {phone}. ", "número {phone}. ", "on {phone} in the evening. ", "{phone}\n", "({phone})\n", "Write or phone: {phone}, {email}. ", "kontakt: {phone}, {email}\n", "the passport {id} was shown. ", "whose social security number was {id}, ", "with SSN {id} on file. ", "mit Ausweis {id} vorgelegt. ", "avec passeport {id} valable. ", "con DNI {id} vigente. ", "insurance number is {id} now. ", "holder of passport {id} of 2020. ", "her identity card, {id}, is lost. ", "in {adresse} seit Mai. ", "in {direccion} desde mayo. ", "in the shop at {address} they sell it. ", "(see {address}) ", "goods for {address}, please. ", "unter {anschrift} zu finden. ", "se encuentra en {direccion}. ", "situé {adresse}. ",
    # addresses
    "Address: {address}\n", "Residence: {address}. ", "Postal address: {address}; ", "residing at {address}. ", "She lives at {address}. ", "Parcels go to {address}. ", "the plant at {address} was closed. ", "of {address}, states the following. ", "at {address} since May. ", "Our store, {address}, is open. ",
    "Anschrift: {anschrift}. ", "Adresse: {anschrift}\n", "wohnhaft {anschrift}. ", "wohnt in der {anschrift}. ", "Das Lager, {anschrift}, ist leer. ", "Sitz: {anschrift}; ",
    "Adresse : {adresse}. ", "demeurant {adresse}. ", "domicilié {adresse}\n", "qui habite {adresse}. ", "au {adresse}, le même jour. ",
    "Domicilio: {direccion}. ", "con domicilio en {direccion}. ", "Dirección: {direccion}\n", "residente en {direccion}. ", "vive en {direccion}; ",
    # phones and mail
    "Tel. {phone}\n", "Tel.: {phone}. ", "tel: {phone}; ", "Fax {phone}. ", "fax: {phone}\n", "Phone: {phone}. ", "Telephone {phone}. ", "Mobile {phone}, ", "Please ring {phone} after noon. ", "Call {phone} at any time. ", "Our line ({phone}) is busy. ", "The desk ({phone}) knows. ", "Telefon {phone}. ", "Telefon: {phone}\n", "Mobil {phone}; ", "Anruf unter {phone} genügt. ", "Die Zentrale ({phone}) hilft. ", "Téléphone : {phone}. ", "tél. {phone}\n", "appeler le {phone} avant midi. ", "Le standard ({phone}) répond. ", "Teléfono: {phone}. ", "llamar al {phone} por la tarde. ", "La centralita ({phone}) atiende. ", "Tel. {phone} / Fax {phone}\n", "{phone} / {email}\n", "(T) {phone} (E) {email}\n", "(T) {phone} (F) {phone}; ", "T: {phone}, E: {email}\n", "Tel. {phone}, Mail {email}. ", "Tel. {phone}, E-Mail {email}\n", "reach me on {phone}. ", "fax {phone}\nTel. {phone}\n",
    "E-Mail: {email}\n", "Email {email}. ", "mailto:{email} ", "mailto:{email}. ", "<{email}> ", "({email}) ", "Write to {email}. ", "Questions go to {email}; ", "Prints can be had from {email}. ", "Schreiben Sie an {email}. ", "Fragen an {email}\n", "Courriel : {email}. ", "écrivez à {email}. ", "Correo: {email}. ", "escriban a {email}; ", "(mail: {email}) ", "See {email}, or ask. ", "{email}\n",
    # identity numbers
    "SSN {id}. ", "SSN: {id}\n", "Social security number {id}; ", "Passport {id}. ", "passport no. {id}, ", "Passport No: {id}\n", "National Insurance no. {id}. ", "NI number {id}\n", "NINO: {id}; ", "tax ID {id}. ", "The declarant ({id}) agreed. ", "identity card {id}. ", "ID {id}\n", "Ausweis Nr. {id}. ", "Personalausweis {id}\n", "Steuer-ID: {id}. ", "Steuernummer {id}; ", "Identifikationsnummer: {id}. ", "Reisepass {id}. ", "numéro de sécurité sociale : {id}. ", "n° de sécurité sociale {id}\n", "NIR {id}. ", "passeport n° {id}. ", "carte d'identité {id}; ", "DNI {id}. ", "DNI: {id}\n", "NIE {id}; ", "con NIF {id}. ", "pasaporte {id}, ", "provisto de documento {id}. ",
)
#: Things that look alike.
TRAPS = (
    "Applicant: [company] Holding\n", "Assignee: [company] & Co.\n", "Licensee: [family] Werke GmbH\n", "Anmelder: [company] AG\n", "Titulaire : [family] SA\n", "Solicitante: [company] S.L.\n", "Owner: [family] Ltd\n", "The [family] Devices catalogue is old. ", "[company] Systems sold it. ", "[family] Labs tested it. ", "a [given] [company] Group product. ", "Manufacturer: [family] Instruments\n", "[given] & [family] Partners paid. ", "the firm [family] Industries, of [town], ", "Opponent: [family] Works\n", "with the [family] method. ", "A [family] gauge was used. ", "the [family] effect is small. ", "The [town] Standard 18/22 applies. ", "[way] Process No. 311 is older. ", "(71) [company] Group ", "(73) [family] Ltd\n", "(51) [A][n2][A] [n1]/[n2] ", "[way] Street Journal wrote so. ", "in [town] at [family] Works. ", "in [town], in May. ", "from [town] to [town] by rail. ", "The [town] plate (12) holds. ", "a [way] stone (14) was cut. ", "Der [town] Versuch endete. ", "bei [town] am Fluss. ", "near [way] Lane there was a well. ", "along [way] Road in winter. ", "The [way] Avenue setting was 12. ", "the [given] of the valley. ", "a [given] bead of size 3. ",
    "Invoice [ssn] was paid. ", "Part no. [ssn] fits. ", "card [ssn] was red. ", "Order [ssn], two boxes. ", "Serial [n4] [n5] [n3]. ", "Serial no. [n9]. ", "Drawing [n1]-[n3]-[n4] shows it. ", "Bestell-Nr. [n8]. ", "Ref. [n3].[n2].[n2] of today. ", "Filed 20[n2]-0[n1]-1[n1], docket [n3].[n2].[n2]. ", "lot [n6]/[n2] passed. ", "Batch @[n3]/lot [n2] is fine. ", "Priority: [AA] 20[n2] [n6] A. ", "Application [AA] [n3]/[n5] is cited. ", "EP [n7] B1 is prior art. ", "US [n1],[n3],[n3] is prior art. ", "[AA][n7][A][n1] is cited. ", "ISBN 978-[n1]-[n4]-[n4]-[n1]. ", "192.168.[n2].[n1] to 10.0.[n2].[n2] were free. ", "The range 10.2.[n1].4 to 10.2.[n1].91 is kept. ", "version [n1].[n2].[n3] of the tool. ", "1[n1].0[n1].20[n2], 11:[n2]. ", "on 20[n2]-1[n1]-2[n1] at noon. ", "[n3] [n3] [n3] units were made. ", "[n1],[n3],[n3] cycles. ", "of [n4] to [n4] mm. ", "between [n3]-[n3] and [n3]-[n3] kPa. ", "Table [n1]: [n2] [n2] [n2] [n2] [n2] [n2]. ", "claims [n1] to [n1], [n2] and [n2]. ", "x = [n3] + [n3] - [n3]. ", "10-[n1] m / [n3] s. ", "model [A][n3]@[n2]bar. ", "Type [A][n6] is sold as [n2]-Line. ", "E_[n1] @ [n3] kPa. ", "[n2] pieces @ [n1] each. ", "article [n6]. ", "Page [n3] of [n3]. ", "file [n8] of the court. ", "type [A][n7] screw. ", "code [AA][n6]. ", "case [n9] was shut. ", "the part [n3] [n2] [n4] is blue. ", "IBAN check [n2] [n4] [n4]. ", "Colour [n3]-[n2]-[n4] fits. ", "Room [n3] Floor [n1]. ", "rue étroite en [n4]. ", "en place depuis [n1] ans. ", "Square [n1] of the board. ", "[n1] Row [n2] of the sheet. ", "Place [n1] in Class [n2]. ", "Am Rand [n1] mm. ", "Im Bereich [n2] bis [n2]. ", "Zum Schluss [n2] Teile. ", "Unter Last [n2] N. ", "ISO [n4] and DIN [n5] apply. ", "part number [A][n8]. ", "certificate [AA] [n2] [n2] [n2] [A]. ",
    "[adj_de] [noun_de]\n", "[adj_de] [noun_de]n halten lange. ", "[adj_de] [noun_de] und [noun_de]\n", "[noun_de] [noun_de] (12) fehlt. ", "[verb_de] die [noun_de] (14), so hält sie. ", "[verb_de] [noun_de] (16) zu früh, endet es. ", "mit dem [noun_de] [noun_de] (10) verbunden. ", "von [noun_de] [noun_de] 15 oder 16. ", "Auf ältere [noun_de] [AA] [n3]/[n5] wird verwiesen. ", "[adj_de] [noun_de] [AA] [n4]\n", "[AA][n7]A1 [adj_de] [noun_de]\n\n", "[AA][n7]B2 — [noun_de]\n", "[AA][n6]U1 [noun_de] ([noun_de])\n\n", "[adj_en] [noun_en]\n", "[adj_en] [noun_en] (12) is used. ", "[noun_en] [noun_en]\n\n", "[AA][n7]A1 [noun_en] [noun_en]\n", "[heading]\n", "[heading]\n\n", "[heading]\nThe pump. ", "[heading] [heading]\n", "[noun_en] [noun_en] Corp sold it. ", "Ist [noun_de] [noun_de] heiß? ", "in 40 [noun_de]n, [noun_de]n, beidseitig. ", "ein [noun_de], [noun_de] (14) und [noun_de]. ", "1. [noun_de], [noun_de] (12) und mehr. ", "mit dem [noun_de] der [noun_de] (12) verbunden. ", "vor dem [noun_de] von [noun_de] (14). ", "vor und nach dem [noun_de] von der [noun_de] (12). ", "[adj_de] [noun_de]n verschleißen früh, weil es reibt. ", "auf dem [noun_de] das [noun_de] (16) sitzt. ", "[noun_de] der [noun_de] [noun_de]. ", "[adj_de] [adj_de] [noun_de]. ",
    "CLAIMS\n1. A pump with a seal.\n2. The pump of claim 1.\n", "ABSTRACT\nThe pump has a seal.\n", "ZUSAMMENFASSUNG\nDie Pumpe hat eine Dichtung.\n", "ABRÉGÉ\nLa pompe a un joint.\n", "RESUMEN\nLa bomba tiene una junta.\n", "Technical Field\nPumps.\n", "Brief Description\n", "Short Summary\nOf pumps.\n", "Figure Three shows Part Two. ", "Stand der Technik\n", "Kurze Beschreibung\n", "Table Of Contents\n", "United Nations rules hold. ", "North Sea gas was used. ", "European Patent Office rules apply. ", "Chapter Two. ", "Bosch Diesel, Turbo Charger and Power Steering. ", "Klasse Eins Prüfung. ", "Carbon Fibre Tube, Hot Water. ",
)
FILLER = (
    "The pump (12) moves water. ", "A seal (14) closes the tank (16) when the pressure rises above 30 kPa. ", "In a second form the lid is made of steel. ", "Heat flows through the wall. ", "Fig. 2 shows the lid (18). ", "[0004] The lid opens. ", "Tests of 40 hours showed no wear. ",
    "Die Pumpe (12) fördert Wasser. ", "Eine Dichtung (14) schließt den Behälter (16) bei hohem Druck. ", "Der Deckel besteht aus Stahl. ", "Fig. 3 zeigt den Deckel (18) im Schnitt. ", "Nach 40 Stunden war kein Verschleiß zu sehen. ", "Vorteilhaft ist eine Feder im Gehäuse. ",
    "La pompe (12) déplace l'eau. ", "Un joint (14) ferme la cuve (16). ", "Le couvercle est en acier. ", "La figure 2 montre le couvercle (18). ", "La bomba (12) mueve el agua. ", "Una junta (14) cierra el tanque (16). ", "La tapa es de acero. ", "La figura 2 muestra la tapa (18). ",
    "\n", "\n\n", "", "",
)

HELD_OUT = (
    "{name} lives in [town] and {name} works with her. ", "You can find {name} in the archive. ", "Minutes taken by {name}.\n", "Chair: {name}; secretary: {name}\n", "As {name} put it, the lamp failed. ", "Mr. {title} phoned on Friday. ", "Frau {title} hat den Antrag gestellt. ", "Der Sachverständige {name} hat das geprüft. ", "D'après le rapport de {name}, rien ne bougeait. ", "El perito {name} revisó la caja. ", "Yours sincerely,\n{name}\n", "Submitted by {name}, {address}.\n", "Send samples to {address}. ", "The shop ({address}) has them. ", "Meine neue Anschrift lautet {anschrift}. ", "Elle réside {adresse}. ", "La nave está en {direccion}. ", "My number is {phone}. ", "Rückruf erbeten: {phone}. ", "Joignable au {phone}. ", "Contacto: {phone}, {email}. ", "His social security number is {id}. ", "Her passport {id} expired. ", "Mit Personalausweis {id} ausgewiesen. ", "titulaire du passeport {id}. ", "titular del DNI {id}. ", "Reply to {email} please. ", "Nachricht an {email} genügt. ", "The group around {name} built it. ", "Interview with {name}\n",
    "Supplier: [company] Ltd. ", "Purchase order [n3]-[n2]-[n4] was sent. ", "The train from [town] stopped. ", "Stock [n6], shelf [n2]. ", "A meeting in [town] on 20[n2]-0[n1]-1[n1]. ", "[family] Motors built [n3] cars. ", "Model [n4]-[n4]. ", "the gallery on [way] Street is shut. ", "Die Firma [company] GmbH liefert. ", "Version [n1].[n1].[n2] runs. ", "The [family] theorem helps. ",
)


def _other(kind: str, r: random.Random, w: World) -> str:
    if kind == "ssn":
        return _mask(r, "###-##-####")
    if kind == "A" or kind == "AA":
        return _mask(r, "@" * len(kind))
    if kind[0] == "n" and kind[1:].isdigit():
        return _digits(r, int(kind[1:]))
    words = {"noun_de": NOUNS_DE, "adj_de": ADJECTIVES_DE, "verb_de": VERBS_DE, "noun_en": NOUNS_EN, "adj_en": ADJECTIVES_EN, "heading": HEADINGS}
    x = r.choice(words[kind] if kind in words else getattr(w, kind))
    return x.upper() if r.random() < 0.1 else x


def sample(n: int, seed: int, world: World, templates: tuple[str, ...] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts of a few sentences each, with their spans."""
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        if templates:
            chosen = r.sample(templates, 3)
        else:
            chosen = [r.choice(TEMPLATES), r.choice(FILLER), r.choice(TRAPS), r.choice(FILLER), r.choice(TEMPLATES), r.choice(FILLER), r.choice(TRAPS)]
            r.shuffle(chosen)
        for template in chosen:
            if r.random() < 0.06:
                template = re.sub(r"[.;,]? $", "; ", template).replace("\n", " ")
            elif r.random() < 0.1:
                template = template.rstrip() + "\n"
            elif r.random() < 0.1:
                template = template.rstrip(" .;\n") + "\n\n"
            for piece in re.split(r"([{\[][A-Za-z]\w*[}\]])", template):
                if m := re.fullmatch(r"([{\[])(\w+)[}\]]", piece):
                    if m[1] == "{":
                        value = r.choice(world.family) if m[2] == "title" else _fill(m[2], r, world)
                        spans.append((len(text), len(text) + len(value), _KIND.get(m[2], m[2])))
                    else:
                        value = _other(m[2], r, world)
                    text += value
                else:
                    text += piece
        out.append((text, spans))
    return out


# --- likelihood ----------------------------------------------------------------------------------


def _groups(spans: list[Span]) -> Iterator[list[Span]]:
    """Runs of candidates that overlap or may have a transition; the field falls apart between them."""
    group: list[Span] = []
    end = 0
    for s in spans:
        if group and s.start > end + REACH:
            yield group
            group = []
        group.append(s)
        end = max(end, s.end) if len(group) > 1 else s.end
    if group:
        yield group


class Field:
    """Groups of candidates padded to batches of equal size; ``gradient`` of the log-likelihood of a batch."""

    def __init__(self, data: list[tuple[str, list[tuple[int, int, str]]]], lex: Lexicon):
        self.index: dict[str, int] = {}
        self.missed = 0  # labelled spans that are no candidates
        groups = []
        for text, gold in data:
            t, _ = tokens([text], lex)
            spans = candidates(t)
            wanted = set(gold)
            self.missed += len(wanted - {(s.start, s.end, s.kind) for s in spans})
            for g in _groups(spans):
                groups.append(self._group(t.text, sorted(g, key=lambda s: (s.end, s.start)), wanted))
        groups.sort(key=lambda g: g[0])
        self.batches = []
        batch: list = []
        for g in groups:
            n = g[0]
            if batch and (len(batch) + 1) * n * n > BATCH:
                self.batches.append(self._pad(batch))
                batch = []
            batch.append(g)
        if batch:
            self.batches.append(self._pad(batch))

    def _id(self, f: str) -> int:
        return self.index.setdefault(f, len(self.index))

    def _group(self, text: str, spans: list[Span], wanted: set) -> tuple:
        feats = [[self._id(f) for f in s.features] for s in spans]
        pairs = []
        start = np.array([s.start for s in spans])
        end = np.array([s.end for s in spans])
        chosen = [i for i, s in enumerate(spans) if (s.start, s.end, s.kind) in wanted]
        gap = start[None, :] - end[:, None]
        for j, i in zip(*np.nonzero((gap >= 0) & (gap <= REACH))):
            between = text[end[j] : start[i]]
            if sum(c.isalnum() for c in between) <= 3:
                pairs.append((int(j), int(i), self._id(transition(text, spans[j], spans[i]))))
        follows = set(zip(chosen, chosen[1:]))
        return len(spans), feats, start, end, chosen, pairs, [(j, i) in follows for j, i, _ in pairs]

    def _pad(self, groups: list) -> dict:
        size, count = max(g[0] for g in groups), len(groups)
        ok = np.zeros((count, size, size), bool)
        there = np.zeros((count, size), bool)
        gold = np.zeros((count, size))
        flat, row, at, pair_at, pair_f, pair_gold = [], [], [], [], [], []
        for b, (n, feats, start, end, chosen, pairs, follows) in enumerate(groups):
            there[b, :n] = True
            ok[b, :n, :n] = end[:, None] <= start[None, :]
            gold[b, chosen] = 1
            for i, f in enumerate(feats):
                flat += f
                row += [b * size + i] * len(f)
            for (j, i, f), y in zip(pairs, follows):
                pair_at.append((b * size + j) * size + i)
                pair_f.append(f)
                pair_gold.append(y)
        return {"size": size, "count": count, "ok": ok, "there": there, "gold": gold, "flat": np.array(flat), "row": np.array(row), "pair_at": np.array(pair_at, np.int64), "pair_f": np.array(pair_f, np.int64), "pair_gold": np.array(pair_gold, float)}

    def gradient(self, b: dict, w: np.ndarray) -> tuple[float, np.ndarray]:
        n, count = b["size"], b["count"]
        s = np.bincount(b["row"], w[b["flat"]], count * n).reshape(count, n)
        s[~b["there"]] = -np.inf
        link = np.where(b["ok"], 0.0, -np.inf)
        link.reshape(-1)[b["pair_at"]] += w[b["pair_f"]]
        alpha, beta = np.full((count, n), -np.inf), np.zeros((count, n))
        for i in range(n):  # spans in order of their ends
            into = alpha[:, :i] + link[:, :i, i]
            top = np.maximum(0.0, into.max(axis=1, initial=-np.inf))
            alpha[:, i] = s[:, i] + top + np.log(np.exp(-top) + np.exp(into - top[:, None]).sum(axis=1))
        for i in range(n - 1, -1, -1):
            out = link[:, i, i + 1 :] + s[:, i + 1 :] + beta[:, i + 1 :]
            top = np.maximum(0.0, out.max(axis=1, initial=-np.inf))
            beta[:, i] = top + np.log(np.exp(-top) + np.exp(out - top[:, None]).sum(axis=1))
        top = np.maximum(0.0, alpha.max(axis=1))
        z = top + np.log(np.exp(-top) + np.exp(alpha - top[:, None]).sum(axis=1))
        p = np.exp(alpha + beta - z[:, None])
        g = np.bincount(b["flat"], (b["gold"] - p).reshape(-1)[b["row"]], len(w))
        value = (s[b["there"]] * b["gold"][b["there"]]).sum() - z.sum()
        if len(b["pair_at"]):
            c, rest = np.divmod(b["pair_at"], n * n)
            j, i = np.divmod(rest, n)
            both = np.exp(alpha[c, j] + link[c, j, i] + s[c, i] + beta[c, i] - z[c])
            g += np.bincount(b["pair_f"], b["pair_gold"] - both, len(w))
            value += (w[b["pair_f"]] * b["pair_gold"]).sum()
        return value, g


def fit(data: list, lex: Lexicon, epochs: int = EPOCHS, field: Field | None = None) -> dict[str, float]:
    """Weights of greatest penalised likelihood."""
    field = field or Field(data, lex)
    w = np.zeros(len(field.index))
    mean, square, step = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(field.batches)):
            b = field.batches[k]
            _, g = field.gradient(b, w)
            g = g / b["count"] - PENALTY * w
            step += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.995 * square + 0.005 * g * g
            rate = RATE * (1 - epoch / epochs) + 0.005
            w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.995**step)) + 1e-6)
    return {f: float(w[i]) for f, i in field.index.items() if abs(w[i]) > 1e-3}


@cache
def fitted() -> dict[str, float]:
    """The weights; deterministic, some seconds of work on the driver."""
    world = World(SEED)
    return fit(sample(SENTENCES, SEED, world), world.lexicon)


def scores(data: list, lex: Lexicon, weights: dict[str, float]) -> dict[str, tuple[int, int, int]]:
    """Per kind: right, said, there."""
    out: dict[str, list[int]] = {}
    for (_, gold), segs in zip(data, decode([t for t, _ in data], lex, weights)):
        got = {(s.start, s.end, s.kind) for s in segs}
        for i, xs in enumerate((got & set(gold), got, gold)):
            for x in xs:
                out.setdefault(x[2], [0, 0, 0])[i] += 1
    return {k: tuple(v) for k, v in out.items()}


def held_out(n: int = 600, seed: int = 99, known: bool = True) -> tuple[list, Lexicon]:
    """Texts of other wording, names and places; the lexicon knows two in five of those, or nothing."""
    world = World(seed + 1)
    return sample(n, seed, world, HELD_OUT), world.lexicon if known else Lexicon()


def accuracy(weights: dict[str, float] | None = None, **kw) -> tuple[float, float]:
    """Precision and recall of spans on held-out texts."""
    data, lex = held_out(**kw)
    right, said, there = (sum(x) for x in zip(*scores(data, lex, fitted() if weights is None else weights).values()))
    return right / max(1, said), right / max(1, there)
