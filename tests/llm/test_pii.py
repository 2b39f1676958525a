from itertools import combinations

import numpy as np
import pytest

from ticktally.llm import pii, pii_spans, pii_train

LEX = pii.Lexicon([("Orlen", "given"), ("Amber", "given"), ("Kelmander", "family"), ("van Yssen", "family"), ("Stone", "family"), ("Larkspine", "street"), ("Port Hesmer", "town"), (None, "given"), ("x", "other")])
W = pii_train.fitted()


def found(text):
    (segs,) = pii.decode([text], LEX, W)
    return sorted((s.kind, text[s.start : s.end]) for s in segs)


@pytest.mark.parametrize("text, want", [
    ("Inventor(s): KELMANDER, Orlen\nABSTRACT\nThe pump", [("name", "KELMANDER, Orlen")]),
    ("Inventors: Orlen Kelmander; Mirek Tolvane / Amber van Yssen.", [("name", "Amber van Yssen"), ("name", "Mirek Tolvane"), ("name", "Orlen Kelmander")]),
    ("The trial was supervised by Orlen\nKelmander in the second week.", [("name", "Orlen\nKelmander")]),
    ("Dr. van Yssen repeated it. Herr Stone auch.", [("name", "Stone"), ("name", "van Yssen")]),
    ("Applicant: Stone Holding. Kelmander Devices sells a Larkspine 423 gauge. A amber coupling.", []),
    ("Write to o.kelmander (at) mail.example.org. Or a+b[at]x[dot]example", [("email", "a+b[at]x[dot]example"), ("email", "o.kelmander (at) mail.example.org")]),
    ("Valve V968@52bar, batch @392/lot 87, E_2 @ 985 kPa = 1.", []),
    ("Tel. (202) 555-0195 ext. 14; fax +49 (0)30 23125-608.", [("phone", "(202) 555-0195 ext. 14"), ("phone", "+49 (0)30 23125-608")]),
    ("Tél. +33 1 99 00 10 02. 8 is a section.", [("phone", "+33 1 99 00 10 02")]),
    ("Telephone +４４ ２０ ７９４６ ０７９０.", [("phone", "+４４ ２０ ７９４６ ０７９０")]),
    ("Filed under 2064-09-19, docket 798.64.25. Colour card 580-55-0717. Range 192.0.2.27 to 192.0.2.80. Priority: XA 2064 776433 A.", []),
    ("SSN 666-85-4330, passport no. X14962615, con DNI 99.996.609-W, Steuer-ID 02 317 366 722.", [("id_number", "02 317 366 722"), ("id_number", "666-85-4330"), ("id_number", "99.996.609-W"), ("id_number", "X14962615")]),
    ("Residence: Flat 5, 204 Larkspine Court, Port Hesmer.", [("address", "Flat 5, 204 Larkspine Court, Port Hesmer")]),
    ("of 125 LARKSPINE AVENUE\nPORT HESMER 91998, hereby declares", [("address", "125 LARKSPINE AVENUE\nPORT HESMER 91998")]),
    ("wohnhaft Tannenstraße 124, 35527 Neuhof. demeurant 198 bis avenue Verte, 25233 Valmont. Domicilio: C/ Vessel, 144, 2º B, 96003 Osuna.", [("address", "198 bis avenue Verte, 25233 Valmont"), ("address", "C/ Vessel, 144, 2º B, 96003 Osuna"), ("address", "Tannenstraße 124, 35527 Neuhof")]),
    ("", []), ("The pump (12) turns.", []),
])
def test_found(text, want):
    assert found(text) == want


def test_held_out_accuracy():
    """Other wording, names and places than in training; the lexicon knows half of the names."""
    precision, recall = pii_train.accuracy()
    assert precision > 0.96 and recall > 0.94


def test_weights_decide():
    """Without what was learned nothing is left: the weights start from 0."""
    assert pii_train.accuracy({})[1] == 0
    unlike = {f: w for f, w in W.items() if ":shape" not in f and ":sig" not in f and ":near" not in f}
    assert pii_train.accuracy(unlike)[1] < pii_train.accuracy()[1] - 0.1


def test_gradient():
    """Against differences of the likelihood."""
    world = pii_train.World(3)
    field = pii_train.Field(pii_train.sample(30, 3, world), world.lexicon)
    r = np.random.default_rng(1)
    w = r.normal(0, 0.3, len(field.index))
    value = lambda x: sum(field.gradient(b, x)[0] for b in field.batches)
    g = sum(field.gradient(b, w)[1] for b in field.batches)
    for k in r.integers(0, len(w), 12):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert (value(w + step) - value(w - step)) / 2e-5 == pytest.approx(g[k], abs=1e-4)


@pytest.mark.parametrize("text", ["Inventors: Orlen Kelmander, Amber Stone; Mirek", "of Orlen Kelmander\n12 Larkspine Lane, Ulm", "Tel. 1 202 555 0112", "Amber Stone <a.b@x.example>"])
def test_viterbi_is_best(text):
    """Against all segmentations of a small text."""
    t, _ = pii_spans.tokens([text], LEX)
    spans = pii_spans.candidates(t)
    for s in spans:
        s.score = sum(W.get(f, 0) for f in s.features)
    spans = sorted(sorted(spans, key=lambda s: -s.score)[:12], key=lambda s: (s.start, s.end))
    best = pii.viterbi(spans, text, W)

    def total(chosen):
        out = 0.0
        for i, s in enumerate(chosen):
            if i and s.start < chosen[i - 1].end:
                return -1e9
            out += s.score
            if i and s.start - chosen[i - 1].end <= pii.REACH:
                out += W.get(pii.transition(text, chosen[i - 1], s), 0)
        return out

    top = max(total(c) for n in range(6) for c in combinations(spans, n))
    assert total(best) == pytest.approx(top) and best


def test_batches_do_not_matter(monkeypatch):
    """Texts read together give what each gives alone, wherever it stands."""
    texts = [t for t, _ in pii_train.sample(200, 7, pii_train.World(7))] + ["", None, "x", "\n\n", "Orlen"]
    alone = [[(s.start, s.end, s.kind) for s in pii.decode([t], LEX, W)[0]] for t in texts]
    assert [[(s.start, s.end, s.kind) for s in x] for x in pii.decode(texts, LEX, W)] == alone
    monkeypatch.setattr(pii, "OUTSIDE", 700)
    assert [[(s.start, s.end, s.kind) for s in x] for x in pii.decode(texts, LEX, W)] == alone


def test_queries(spark):
    long = "The pump (12) turns. " * 20_000 + "Tel. 202-555-0112."
    rows = [(1, "SSN 666-85-4330 and SSN 666-85-4330", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (4, long, "x"), (5, "Nothing here.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    got = sorted(tuple(r) for r in pii.find(df, "doc_id", "text", LEX, W).distinct().collect())
    assert got == [(1, "id_number", "666-85-4330"), (4, "phone", "202-555-0112")]
    out = {r.doc_id: r for r in pii.redact(df, "doc_id", "text", LEX, W).collect()}
    assert out[1].text == "SSN [ID_NUMBER] and SSN [ID_NUMBER]" and out[1].replaced == 2
    assert out[2].text is None and out[3].text == "" and out[5].text == "Nothing here."
    assert out[4].text == long[: -len("202-555-0112.")] + "[PHONE]."
    assert pii.find(df.limit(0), "doc_id", "text", LEX, W).count() == 0


def test_redaction_keeps_the_rest():
    for text, _ in pii_train.sample(60, 5, pii_train.World(5)):
        (segs,) = pii.decode([text], LEX, W)
        last = 0
        for s in segs:
            assert last <= s.start < s.end <= len(text)
            last = s.end


@pytest.mark.parametrize("text, want", [
    ("Anna Bergström lives in Uppsala and Peter Johansson works with her.", [("name", "Anna Bergström"), ("name", "Peter Johansson")]),
    ("Please reach Maria Lopez at 0171 2345678 today.", [("name", "Maria Lopez"), ("phone", "0171 2345678")]),
    ("Her SSN is 123-45-6789.", [("id_number", "123-45-6789")]),
    ("John Smith confirmed the order.", [("name", "John Smith")]),
    ("Part no. 571-55-0188 was red. Version 3.4.12 of 2031-02-11.", []),
])
def test_free_sentences_without_a_lexicon(text, want):
    (segs,) = pii.decode([text], pii.Lexicon(), W)
    assert sorted((s.kind, text[s.start : s.end]) for s in segs) == want


def test_stretches_of_long_texts(monkeypatch):
    """A text read in overlapping stretches gives what it gives as a whole."""
    text = " ".join(t for t, _ in pii_train.sample(300, 8, pii_train.World(8)))
    (whole,) = pii.decode([text], LEX, W)
    monkeypatch.setattr(pii, "LONG", 4_000)
    monkeypatch.setattr(pii, "MARGIN", 900)
    (parts,) = pii.decode([text], LEX, W)
    as_tuples = lambda segs: [(s.start, s.end, s.kind) for s in segs]
    assert len(text) > 30_000 and as_tuples(parts) == as_tuples(whole)


def test_long_texts_are_read_in_linear_time():
    text = "; ".join(["Orlen Kelmander"] * 20_000) + " " + "12 345 678 " * 20_000
    (segs,) = pii.decode([text], LEX, W)
    assert sum(s.kind == "name" for s in segs) == 20_000


@pytest.mark.parametrize("text, want", [
    ("The pump (12) turns. " * 9 + t + " The pump (12) turns." * 9, [("name" if k is None else k, w) for k, w in w])
    for t, w in (
        ("National Insurance no. QQ  77 90 92 C.", [("id_number", "QQ  77 90 92 C")]),
        ("SSN ６６６-８５-４３３０.", [("id_number", "６６６-８５-４３３０")]),
        ("Author: Mirek Tolvane, room 4.", [(None, "Mirek Tolvane")]),
        ("It was drawn by Mirek Kelmander here.", [(None, "Mirek Kelmander")]),
        ("Dessin par Orlen Tolvane ici.", [(None, "Orlen Tolvane")]),
        ("See Mme Tolvane about it.", [(None, "Tolvane")]),
        ("Authors: Mirek Tolvane; Jorel Banvik; Odra Felkin; Tasso Gruvin; Pavo Lindrek met.", [(None, x) for x in ("Jorel Banvik", "Mirek Tolvane", "Odra Felkin", "Pavo Lindrek", "Tasso Gruvin")]),
        ("demeurant 12, av. Verte, 25233 Valmont.", [("address", "12, av. Verte, 25233 Valmont")]),
        ("wohnhaft Tannenstraße 124, 35527 Überlingen.", [("address", "Tannenstraße 124, 35527 Überlingen")]),
        ("Domicilio: Apdo. 154, 25233 Osuna.", [("address", "Apdo. 154, 25233 Osuna")]),
    )
])
def test_within_long_texts(text, want):
    assert found(text) == want
