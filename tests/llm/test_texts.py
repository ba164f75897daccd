import random

import pytest
from pyspark.sql import functions as F

from lorefold.llm.names import Lexicon, common_words, keys_of, keys_to, link_names, own_words, parse, skeleton
from lorefold.llm.pii import find_personal, occurrences, redact
from lorefold.llm.surface import KINDS, surface_spans
from lorefold.llm.spam import spam_documents, spam_scores


def prose(n):
    """n sentences of different words."""
    return " ".join(f"We met {chr(97 + i % 26)}nna{i}berg at the s{i}tation and t{i}alked about her p{i}lan." for i in range(n))


PROSE = prose(2)


def test_spam(spark):
    cases = {
        1: "yoga mat cheap, yoga mat best, yoga mat online, yoga mat price, " * 5, 2: "notebook NOTEBOOK Notebook notebook buy notebook " * 4,
        3: "\n".join(f"* https://shop{i}.example/p?id={i}" for i in range(12)), 4: " ".join(f"#lamp{w}" for w in "best cheap free deal online buy price top review near for now new".split()),
        5: PROSE + "\n" + "backpack deal\nbackpack free\nplanner cheap\nplanner deal\nbackpack cheap\n" * 8,
        6: "\n".join(f"[rain jacket {w}](http://x.example/{w})" for w in "best cheap free deal online buy".split()),
        8: "\n".join(f"kiosk{i}.{t}" for i in range(10) for t in ("de", "io", "shop")), 9: " / ".join(f"{a} {b}" for a in ("leather", "canvas", "woollen") for b in ("shoes", "bags", "belts", "hats", "gloves")),
    }
    fine = {
        20: prose(6), 21: "yoga mat", 22: "survey\n- archive\n- contract\n- report\n- van\n- packing list\n- price table\n- guest list\n- menu", 23: "Anna, Bert, Carla, David, Emil, Frida, Gustav, Hanna, Ivan, Jonas, Karla, Lena",
        24: "\n".join(f"{s}. https://notes.example/{i}" for i, s in enumerate(prose(6).split(". "))), 25: "", 26: None, 27: prose(800),
        28: (refrain := "\n".join(["The river carries all my sorrow home", "and I will follow it until the morning comes", "with nothing but the light upon my hands"])) + "".join("\n" + prose(40 + i).split(". ")[-2] + ".\n" + refrain for i in range(3)),
    }
    rows = [(i, t, "x") for i, t in [*cases.items(), *fine.items()]] + [(7, cases[1], "copy"), (None, cases[1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language string")
    assert sorted(r.doc_id for r in spam_documents(docs).collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert spam_scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("Mail ann.lee+x@mail.example.com now", "email", "ann.lee+x@mail.example.com"), ("mail ann dot lee at post dot town dot example the draft", "email", "ann dot lee at post dot town dot example"),
    ("Mail wanda22 (at) tolver.example.", "email", "wanda22 (at) tolver.example"), ("Call Al back on +44 20 7946 0168.", "phone", "+44 20 7946 0168"), ("call al back on four one five five double five oh one seven three", "phone", "four one five five double five oh one seven three"),
    ("Ann's desk: (415) 555-0125 Action", "phone", "(415) 555-0125"), ("030/23125-851 is the desk line", "phone", "030/23125-851"), ("Ann gave SSN 929-01-6949, keep it", "id_number", "929-01-6949"), ("gave nino qq 51 39 37 a keep", "id_number", "qq 51 39 37 a"),
    ("gave ssn nine five eight oh seven six double one eight keep", "id_number", "nine five eight oh seven six double one eight"), ("DNI 00096035-M, keep", "id_number", "00096035-M"), ("lives at Flat 12, 163 Tanner Court now", "address", "Flat 12, 163 Tanner Court"),
    ("vive en C/ Tres Molinos 28, 8º D", "address", "C/ Tres Molinos 28, 8º D"), ("wohnt Am Mühlgraben 224, 02626 Ilmbruck", "address", "Am Mühlgraben 224, 02626 Ilmbruck"), ("habite 176 bis, rue des Merles", "address", "176 bis, rue des Merles"), ("in Birkenallee 69 now", "address", "Birkenallee 69"),
    ("NINO: AB 12 34 56 C", "id_number", "AB 12 34 56 C"), ("national insurance number AB123456C", "id_number", "AB123456C"), ("Reisepass C01X00T47", "id_number", "C01X00T47"), ("it is 123-45-6789 I think", "id_number", "123-45-6789"),
    ("tel 030 1234567", "phone", "030 1234567"), ("call one-two-three-four-five-six-seven-eight now", "phone", "one-two-three-four-five-six-seven-eight"), ("al 07700 900463", "phone", "07700 900463"),
])
def test_surface(text, kind, found):
    spans = surface_spans(text)
    assert [(text[a:b], KINDS[k]) for a, b, k in spans if KINDS[k] != "other"] == [(found, kind)]


@pytest.mark.parametrize("text", ["Pinned planner@5.2.8 in the build", "Ping @design about order no. 2779 6199", "Read case 931885/22, page 283", "Meeting moved to 19:30 on 23.12.2026", "isbn 978-0-00-144646-2", "see 203.0.113.15", "Street fair in town, block 12 Market hall", "the €8 049,00 quote", "Treffen am 9/20 um 16:45", "about yoga at 5 past nine", "12345678A is no checked number"])
def test_no_personal_information(text):
    assert surface_spans(text) == []


def test_account_numbers_hold_no_phone():
    text = "Pay to DE89 3704 0044 0532 0130 00 by Monday"
    assert [KINDS[k] for _, _, k in surface_spans(text)] == ["other"]


def test_shapes_and_streets_learned_from_contexts(spark):
    """Numbers of a shape, and streets of a kind, that no grammar takes are found by the contexts they share with seeds."""
    notes = [f"Form asks for tax id {9000 + i} {1000 + 7 * i} {2000 + 3 * i} for the file" for i in range(6)] + [f"The registry sent 9{i:03} 5678 9012 for the file" for i in range(3)]
    notes += [f"Form asks for tax code 9{i:03} 5678 9012 for the file" for i in range(2)]
    notes += [f"Ann lives at {10 + i} Larch Street with Bert" for i in range(6)] + [f"Carl lives at {30 + i} Larch Gardens with Dora" for i in range(6)]
    notes += [f"We will mark order 1{i:03} 5678 9012 as done" for i in range(9)] + ["Read 12 Larch Books on the way"]
    rows = [(f"c{i:02}", t, None) for i, t in enumerate(notes)]
    empty = spark.createDataFrame([], "text string")
    found = find_personal(spark.createDataFrame(rows, "capture_id string, raw_text string, corrected_text string"), empty, empty)
    got = {(r.capture_id, r.pii_kind) for r in occurrences(found).collect() if r.pii_kind != "person_name"}
    want = {(f"c{i:02}", "id_number") for i in range(11)} | {(f"c{i:02}", "address") for i in range(11, 23)}
    assert want - {(f"c{i:02}", "id_number") for i in range(6, 9)} <= got <= want


def test_short_surnames(spark):
    """Short seeds and short learned names are taken after a given name, and elsewhere where their context says so."""
    people = [(f"{g} {s}",) for g in ("Bernard", "Anna", "Clara", "Quentin") for s in ("Koch", "Feningoreira", "Skelpelaraux", "Ostcaminoglu")]
    notes = [f"Call {n} back on Monday" for (n,) in people] + ["Then Anna Koch agreed", "Koch, Anna agreed"]
    found = find_personal(spark.createDataFrame([(f"c{i:02}", t, None) for i, t in enumerate(notes)], "capture_id string, raw_text string, corrected_text string"), spark.createDataFrame(people, "text string"), spark.createDataFrame([], "text string"))
    got = {(r.capture_id, r.start_pos) for r in occurrences(found).collect()}
    n = len(people)
    assert {(f"c{i:02}", 5) for i in range(n + 1)} <= got


def test_names_in_notes(spark):
    people = [(f"{g} {s}",) for g in ("Hope", "Anna", "Mark", "Quentin") for s in ("Feningoreira", "Skelpelaraux", "Bramfliet", "Ostcaminoglu")]
    notes = [f"Call {n} back on 555-0142." for (n,) in people] + ["Hope the Levcepexus project pays off.", "lunch with anna skelpelaruax mostly", "Told Dr Skelpelaraux, Anna that it is late", "", None]
    rows = [(f"c{i}", t, None, "x") for i, t in enumerate(notes)] + [("c0", notes[0], None, "x")]
    captures = spark.createDataFrame(rows, "capture_id string, raw_text string, corrected_text string, spans string")
    found = find_personal(captures, spark.createDataFrame(people, "text string"), spark.createDataFrame([("Levcepexus Survey Launch",)], "text string"))
    got = {(r.capture_id, r.pii_kind, r.start_pos) for r in occurrences(found).collect()}
    n = len(people)
    assert {(f"c{i}", "person_name", 5) for i in range(n)} | {(f"c{i}", "phone", notes[i].index("555")) for i in range(n)} <= got
    assert not [g for g in got if g[0] == f"c{n}"]
    assert (f"c{n + 1}", "person_name", 11) in got
    assert (f"c{n + 2}", "person_name", 8) in got
    texts = {r.capture_id: r.redacted for r in redact(found).collect()}
    assert texts["c0"] == "Call [PERSON_NAME] back on [PHONE]."


@pytest.mark.parametrize("others", [0, 7_000])
def test_unlisted_surname(spark, others):
    """A surname that no list has is learned from its contexts, however frequent it is and however many words the corpus has."""
    people = [(f"{g} {s}",) for g in ("Bernard", "Anna", "Clara", "Quentin") for s in ("Feningoreira", "Skelpelaraux", "Bramfliet", "Ostcaminoglu")]
    notes = [f"Call {n} back on Monday" for (n,) in people] + [f"Call {g} Wolkenbrettig back on Monday" for g in ("Bernard", "Anna", "Clara")] * 2 + ["Then Wolkenbrettig agreed to the plan"]
    fill = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) + "qulum" for i in range(others)]
    rows = [(f"c{i:02}", t, None) for i, t in enumerate(notes)] + [(f"f{i}", " ".join(fill[i : i + 20]), None) for i in range(0, others, 20)]
    found = find_personal(spark.createDataFrame(rows, "capture_id string, raw_text string, corrected_text string"), spark.createDataFrame(people, "text string"), spark.createDataFrame([("Levcepexus Survey Launch",)], "text string"))
    got = {(r.capture_id, r.pii_kind, r.start_pos) for r in occurrences(found).collect()}
    assert got == {(f"c{i:02}", "person_name", 5) for i in range(len(notes))}


def test_occurrences_alone(spark):
    """What p4_found reads without texts and spans is what ``occurrences`` gives, phone numbers said with commas alone among them."""
    people = [(f"{g} {s}",) for g in ("Bernard", "Anna", "Clara", "Quentin") for s in ("Feningoreira", "Skelpelaraux", "Bramfliet", "Ostcaminoglu")]
    notes = [f"Call {n} back on 555-0142." for (n,) in people] + ["Mail ann@post.example, then Anna at 12 Larch Street", "said one,two,three,four,five,six,seven", "nothing here", "", None]
    args = (spark.createDataFrame([(f"c{i}", t, t and t.upper()) for i, t in enumerate(notes)], "capture_id string, raw_text string, corrected_text string"), spark.createDataFrame(people, "text string"), spark.createDataFrame([], "text string"))
    alone = find_personal(*args, whole=False)
    got = sorted(alone.collect())
    assert alone.columns == ["capture_id", "text_field", "pii_kind", "start_pos"] and got == sorted(occurrences(find_personal(*args)).collect())
    assert ("c17", "raw_text", "phone", 5) in got and {k for _, _, k, _ in got} == {"email", "phone", "address", "person_name"}


def test_parse():
    lexicon = Lexicon(["christopher", "quentin", "augustine"], {})
    for text in ("Quentin Feningoreira", "FENINGOREIRA, Quentin", "Dr Quentin K. Fening-oreira", "quentin fenin goreira"):
        assert parse(text, "Person", lexicon) == (skeleton("feningoreira"), [{"quentin": 1.0}])
    assert parse("Q. Feningoreira", "Person", lexicon)[1] == [{"quentin": 0.05}]
    assert parse("Kester Bramfliet", "Person", lexicon)[1] == [{"christopher": 0.3}]
    assert parse("", "Person", lexicon) == ("", [])


def test_linked_names(spark):
    given = ["Quentin", "Anna", "Bernard", "Clara"]
    surnames = ["Feningoreira", "Skelpelaraux", "Bramflietwell", "Ostcaminoglu"]
    people = [f"{g} {s}" for g in given for s in surnames]
    entities = [(f"e{i:02}", "Person", n) for i, n in enumerate(people)] + [("x1", "Person", "Feningorreira, Quentin"), ("x2", "Person", "Q. Feningoreira"), ("x3", "Person", "Quentin Newname"), ("x4", "Person", None), ("x4", "Person", " "), (None, "Person", "Anna Skelpelaraux"), ("x1", "Person", "Feningorreira, Quentin")]
    aliases = [("x3", "quentin feningoreira"), ("e05", "??"), (None, "x"), ("x3", None)]
    asked = [(f"r{i}", "Person", n, [(n, "")]) for i, n in enumerate(people)] * 2 + [("q1", "Person", "quentin feningoriera", []), ("q2", "Person", "Nobody Known", None), ("q3", "Task", "x", None)]
    pairs = link_names(
        spark.createDataFrame(entities, "entity_id string, entity_type string, name string"), spark.createDataFrame(aliases, "entity_id string, alias string"),
        spark.createDataFrame(asked, "request_id string, entity_type string, mention_text string, candidates array<struct<name:string,summary:string>>"),
    )
    got = {tuple(r) for r in pairs.collect()}
    cluster = ["e00", "x1", "x2", "x3"]
    want = {(a, b) for a in cluster for b in cluster if a < b} | {tuple(sorted((e, r))) for e in cluster for r in ("r0", "q1")} | {tuple(sorted((f"e{i:02}", f"r{i}"))) for i in range(1, len(people))}
    assert got == want
    assert link_names(*(d.limit(0) for d in (spark.createDataFrame(entities, "entity_id string, entity_type string, name string"), spark.createDataFrame(aliases, "entity_id string, alias string"), spark.createDataFrame(asked, "request_id string, entity_type string, mention_text string, candidates array<struct<name:string,summary:string>>")))).count() == 0


def test_two_edits_meet(spark):
    """Every pair within the edits allowed shares a key, wherever the edits are."""
    rng = random.Random(3)
    rows = []
    for n in [*range(1, 16)] * 60:
        a = b = "".join(rng.choices("abcd", k=n))
        for _ in range(rng.randint(0, 2 if n >= 6 else 1)):
            i = rng.randrange(len(b) + 1)
            b = rng.choice((b[:i] + rng.choice("abcd") + b[i:], b[:i] + b[i + 1 :], b[:i] + rng.choice("abcd") + b[i + 1 :]))
        rows += [(a, b)] if b else []
    pairs = spark.createDataFrame(rows, "a string, b string")
    assert [tuple(r) for r in pairs.filter(~F.arrays_overlap(keys_of("a"), keys_to("b"))).collect()] == []


def test_edits_at_both_ends(spark):
    given = ["Benjamin", "Anna", "Bernard", "Clara"]
    people = [f"{g} {s}" for g in given for s in ("Belprieaini", "Skelpelaraux", "Bramflietwell", "Ostcaminoglu")]
    entities = [(f"e{i:02}", "Person", n) for i, n in enumerate(people)] + [("y", "Person", "Anna Beprieaibi")]
    asked = [(f"r{i}", "Person", n, None) for i, n in enumerate(people)] + [("x", "Person", "Benjamin Beprieaibi", [("Benjamin Belprieaini", "")])]
    pairs = link_names(
        spark.createDataFrame(entities, "entity_id string, entity_type string, name string"), spark.createDataFrame([], "entity_id string, alias string"),
        spark.createDataFrame(asked, "request_id string, entity_type string, mention_text string, candidates array<struct<name:string,summary:string>>"),
    )
    assert {tuple(r) for r in pairs.collect()} == {(f"e{i:02}", f"r{i}") for i in range(len(people))} | {("e00", "x")}  # an entity isn't linked by two edits of its own name


def test_lists_decide_between_bearers(spark):
    """An initial shared by two is the one in the request's list; an unknown person close to a known one isn't that one."""
    given = ["Benjamin", "Bernard", "Anna", "Clara"]
    people = [f"{g} {s}" for g in given for s in ("Belprieaini", "Skelpelaraux", "Bramflietwell", "Ostcaminoglu")]
    entities = [(f"e{i:02}", "Person", n) for i, n in enumerate(people)]
    asked = [(f"r{i}", "Person", n, None) for i, n in enumerate(people)]
    asked += [("q1", "Person", "B. Belprieaini", [("Benjamin Belprieaini", ""), ("Anna Ostcaminoglu", "")]), ("q2", "Person", "B. Belprieaini", [("Bernard Belprieaini", "")]), ("q3", "Person", "Anna Skelpalaruax", [("Clara Bramflietwell", "")])]
    pairs = link_names(
        spark.createDataFrame(entities, "entity_id string, entity_type string, name string"), spark.createDataFrame([("e00", "b belprieaini")], "entity_id string, alias string"),
        spark.createDataFrame(asked, "request_id string, entity_type string, mention_text string, candidates array<struct<name:string,summary:string>>"),
    )
    got = {tuple(r) for r in pairs.collect()}
    assert got == {(f"e{i:02}", f"r{i}") for i in range(len(people))} | {("e00", "q1"), ("e04", "q2")}


def test_familiar_forms_among_rare_parts_of_many_words(spark):
    """Ten surnames that forty given names go with, more than the former cap let speak."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda start, i: start + letters[i // 26] + letters[i % 26]
    busy = [word("Busy", i) for i in range(10)]
    people = [f"{word('Given', g)} {b}" for g in range(40) for b in busy] + [f"Zilly {b}" for b in busy]
    people += [f"Zottilie {r}" for r in [*busy, *(word("Rare", i) for i in range(40))]] + [f"{word('Given', i % 40)} {word('Other', i)}" for i in range(640)]
    words, learned = common_words(spark.createDataFrame([("Person", p) for p in people], "kind string, text string"))
    assert learned["Person"] == {"zilly": "zottilie"}
    assert set(words["Person"]) == {word("given", g) for g in range(40)} | {"zottilie"}


def test_misspelt_words_are_no_common_words(spark):
    words = {"rollout": 693, "rolout": 13, "relout": 2, "group": 636, "grp": 188, "prototype": 607, "proto": 180, "audit": 700, "adit": 300}
    assert own_words(words, "Project") == ["audit", "rollout", "group", "prototype", "adit", "relout"]
    assert own_words({"anna": 40, "ana": 30, "robert": 500, "rob": 100, "roberta": 45}, "Person") == ["robert", "rob", "anna", "ana"]
