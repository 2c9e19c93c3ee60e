import pytest

from burstframe.llm import pii

NAMES = pii.Names(
    {"nora": "en", "rose": "en", "ruben": "es", "rubén": "es", "mara": "en", "will": "en", "mark": "en", "hans": "", "john": "", "mary": ""},
    frozenset({"gorrinmann", "tambdale", "velova", "ostrosten"}), frozenset("my words the soup thanks for of street right heute schuldet nichts".split()),
)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail nora.x+y@mail.example.", [("email", "nora.x+y@mail.example")]), ("a (at) b.example ok", [("email", "a (at) b.example")]),
        ("x[at]uni[dot]b[dot]test", [("email", "x[at]uni[dot]b[dot]test")]), ("x AT uni DOT test", [("email", "x AT uni DOT test")]), ("x＠b.example", [("email", "x＠b.example")]),
        ("call +49 (0)30 23125356 now", [("phone", "+49 (0)30 23125356")]), ("(415) 555-0148 only", [("phone", "(415) 555-0148")]), ("07700.900958", [("phone", "07700.900958")]),
        ("212-555-0120", [("phone", "212-555-0120")]), ("order no 4471-22-87", []), ("on 2013-01-14", []), ("score 3-2, 9.99, seat 1424", []),
        ("my passport QQ 12 34 56 C got lost", [("id_number", "QQ 12 34 56 C")]), ("tax id 123456789 again", [("id_number", "123456789")]),
        ("NIE X-0006992-U", [("id_number", "X-0006992-U")]), ("ssn 123-45-6789", [("id_number", "123-45-6789")]), ("mi DNI 01809909I en", [("id_number", "01809909I")]),
        ("to 23 Quarry Lane again", [("street", "23 Quarry Lane")]), ("93 Tanner St. still", [("street", "93 Tanner St.")]), ("C/ Cigüeña, 99a", [("street", "C/ Cigüeña, 99a")]),
        ("le 9, rue des Tilleuls depuis une", [("street", "9, rue des Tilleuls")]), ("in Mühlstraße 240", [("street", "Mühlstraße 240")]), ("in Am Alten Speicher 9", [("street", "Am Alten Speicher 9")]),
        ("the fair on Quarry Lane", []), ("14th avenue is closed", []), ("since 9 o'clock the street artist", []), ("a las 9 la calle principal", []),
        ("Dr Nora Gorrinmann, please", [("person", "Nora Gorrinmann")]), ("by Velova, Rubén and", [("person", "Velova, Rubén")]), ("N. Tambdale", [("person", "N. Tambdale")]),
        ("thibor gorrinmann owes", [("person", "thibor gorrinmann")]), ("Mara J. Velova-Tambdale", [("person", "Mara J. Velova-Tambdale")]), ("met Nora T. Hasksten in", [("person", "Nora T. Hasksten")]), ("Nora Hasksten ran", [("person", "Nora Hasksten")]), ("Mark my words", []),
        ("Rose and Will", []), ("thanks Rose for the soup", []), ("i am Tambdale", []), ("", []), ("x" * 20_000, []),
        ("Nο​rа Gorrinmann", [("person", "Nο​rа Gorrinmann")]),
        ("llama al 612 345 678 hoy", [("phone", "612 345 678")]), ("1-800-555-0199", [("phone", "1-800-555-0199")]), ("am Platz der Republik 1", [("street", "Platz der Republik 1")]),
        ("in der plaza del pozo viejo 12", [("street", "plaza del pozo viejo 12")]), ("John Smith met Mary Jones", [("person", "John Smith"), ("person", "Mary Jones")]),
        ("Müller, Hans", [("person", "Müller, Hans")]), ("von Velova, Thibor", [("person", "Velova, Thibor")]), ("heute schuldet velova nichts", []), ("today Velova paid", []),
        ("Today Velova, Thibor left", [("person", "Velova, Thibor")]), ("THIBOR VELOVA OWES", [("person", "THIBOR VELOVA")]), ("by Velova again", []),
        ("Mrs Velova", []), ("In Ostheim, Mark said so", []), ("who reads velova_nora@mail.example", [("email", "velova_nora@mail.example")]),
    ],
)
def test_find(text, found):
    assert [(k, v) for k, _, _, v, _ in pii.find(text, NAMES)] == found


def test_one_form_of_an_entity():
    assert pii.canonical("person", "Velova, Rubén") == pii.canonical("person", "RUBÉN VELOVA")
    assert pii.canonical("email", "X (at) b.example") == pii.canonical("email", "x＠b.example") == pii.canonical("email", "x AT b DOT example")
    assert pii.canonical("phone", "(415) 555-0148") == pii.canonical("phone", "415.555.0148")


def test_surrogates_keep_the_format():
    make = lambda kind, val: pii.surrogate(kind, val, b"k", 0)
    phone = make("phone", "+49 (0)30 23125356")
    assert phone.startswith("+49 (") and [c.isdigit() for c in phone] == [c.isdigit() for c in "+49 (0)30 23125356"]
    assert make("phone", "(415) 555-0148") != "(415) 555-0148"
    assert make("email", "nora7@mail.example").endswith("@mail.example")
    assert make("street", "23 Quarry Lane").endswith(" Lane")


def person(val, surname, draws=(), initial=None):
    return pii.person_surrogate(val, surname, b"k", dict.fromkeys((*surname.split(), *draws), (0, 0)), initial, NAMES.given)


def test_persons_word_by_word():
    assert person("NORA VELOVA", "velova").isupper() and person("Nora Velova", "velova").split()[0].lower() in NAMES.given
    assert {c.lower() for c in person("Иван Петров", "петров", ["иван"]) if c.isalpha()} <= set("аеиоубвгдзклмнпрст")
    assert person("Velova, Rubén", "velova").replace(",", "").split()[::-1] == person("Rubén Velova", "velova").split()
    assert person("Rose Mark", "mark").split()[1].lower() not in NAMES.given  # a given name that stands as a surname
    first, middle, last = person("Mara J. Velova", "velova").split()
    assert middle[1:] == "." and middle[0] != "J" and f"{first} {last}" == person("Mara Velova", "velova")


def test_given_names_are_exchanged_within_language_and_gender():
    listed = tuple({"beatriz": "pt", "rafaela": "pt", "luísa": "pt", "caio": "pt", "davi": "pt", "gleb": "ru", "arina": "ru", "zzz": "nl"}.items())
    new = pii._exchanged(listed, b"k")
    assert sorted(new) == sorted(new.values()) and all(a != b for a, b in new.items())
    assert {new[g] for g in ("beatriz", "rafaela", "luísa")} == {"beatriz", "rafaela", "luísa"} and new["caio"] == "davi"


def test_initials():
    got = pii.initials([("n", "tessa"), ("m", "tom"), ("r", None), ("t", None)], b"k")
    assert got["m"] == "t" and got["n"] == "te" and len(set(got.values())) == 4
    every = [(c, None) for c in pii._ALPHABETS[0]]
    assert len(set(pii.initials(every, b"k").values())) == 26


def test_redaction(spark):
    rows = [
        ("t", "1", "ask Nora Velova or nora velova at a@b.example!"), ("t", "2", "Velova, Nora"), ("t", "3", "nothing"), ("t", "4", None), ("t", "5", ""),
        ("t", "1", "ask Nora Velova or nora velova at a@b.example!"), (None, None, "a@b.example"), ("t", "6", "N. Velova"), ("t", "7", "R. Velova"), ("u", "3", None), ("t", "1", None), (None, "8", "by a@b.example"),
    ]
    df = spark.createDataFrame(rows, "src string, rec_id string, text string").selectExpr("*", "'clash' AS kind", "'x' AS own")
    listed = [tuple(r) for r in pii.redact(df, NAMES, b"k").collect()]
    out = {(s, i): (p, x) for s, i, p, x in listed}
    assert len(out) == len(listed) == 9 and out[None, "8"][0] == "by [EMAIL]"
    assert out["t", "1"][0] == "ask [PERSON] or [PERSON] at [EMAIL]!"
    a, b = out["t", "1"][1].removeprefix("ask ").split(" at ")[0].split(" or ")
    assert a.lower() == b and sorted(out["t", "2"][1].split(", ")) == sorted(a.split())
    first, last = a.split()
    assert out["t", "6"][1] == f"{first[0]}. {last}"  # the initial stands for the only given name of that surname
    assert out["t", "7"][1].endswith(f". {last}") and out["t", "7"][1][0] not in (first[0], "R")
    assert {k: out[k] for k in [("t", "3"), ("t", "4"), ("t", "5"), ("u", "3")]} == {("t", "3"): ("nothing",) * 2, ("t", "4"): (None, None), ("t", "5"): ("", ""), ("u", "3"): (None, None)}
    found = pii.find_entities(df, NAMES)
    assert pii.entity_rows(pii.replacements(found, NAMES, b"k")).count() == 7
    assert pii.entity_rows(pii.replacements(found.limit(0), NAMES, b"k")).count() == 0


def test_collisions_are_drawn_again(spark):
    entities = spark.createDataFrame([("phone", f"0{i}", f"0{i}") for i in range(10)], "kind string, form string, val string")
    drawn = pii.surrogates(entities, b"k", rounds=1).collect()
    assert len(drawn) == 10 and any(r.attempt for r in drawn)  # ten forms of one free digit must collide


def test_no_surrogate_is_shared(spark):
    """Twenty thousand numbers of five digits fill a fifth of their space."""
    rows = [("id_number", f"{i * 5:05d}", f"{i * 5:05d}") for i in range(20_000)] + [("street", f"{i} ab lane", f"{i} Ab Lane") for i in range(10)] + [("name", "velova", "velova"), ("email", "a@b.example", "a@b.example")]
    drawn = pii.surrogates(spark.createDataFrame(rows, "kind string, form string, val string"), b"k", spark.createDataFrame([("name", "nora")], "kind string, drawn string")).collect()
    vals = {(k, f): v for k, f, v in rows}
    made = [(r.kind, pii.canonical(r.kind, pii.surrogate(r.kind, vals[r.kind, r.form], b"k", r.attempt, r.longer))) for r in drawn]
    assert len(made) == len(set(made)) == len(rows) and not set(made) & set(vals)


def test_personal_domains_are_replaced():
    make = lambda val: pii.surrogate("email", val, b"k", 0)
    assert make("nora@velova.de").endswith(".example") and "velova" not in make("nora@velova.de")
    assert make("nora (at) velova [dot] de").endswith(" [dot] example")
    assert make("nora@velova.de").split("@")[1] == make("rose@velova.de").split("@")[1]


def test_learned_names(spark):
    users = spark.createDataFrame([("1", "Nora Velova"), ("2", "Rose Velova"), ("3", "Nora Once"), ("4", "Vaesseby Radio"), ("5", "Nora Tambdale Official"), ("6", None), ("1", "Nora Velova"), ("7", "Rose The")], "id_str string, name string")
    given = spark.createDataFrame([("Nora", "en"), ("Rose", "en"), (None, None)], "given_name string, lang string")
    corpus = spark.createDataFrame([("the rose",), (None,)], "text string")
    names, more = pii.learn_names(users, given, corpus)
    assert names.surnames == {"velova", "once"} and names.common == {"the"} and more is None
    assert pii.learn_names(users.limit(0), given.limit(0), corpus.limit(0))[0].surnames == frozenset()
    few, table = pii.learn_names(users, given, corpus, most=1)
    assert few.surnames == frozenset() and {r.surname for r in table.collect()} == names.surnames
    texts = spark.createDataFrame([("t", "1", "by Velova, Rose."), ("t", "1", "by Velova, Rose."), ("t", "2", "thibor once"), ("t", "3", "Nο​rа Velоva"), ("t", "4", None), (None, None, "x"), (None, "5", "Rose Velova")], "src string, rec_id string, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(pii.find_entities(texts, few, table, all_rows=True)) == rows(pii.find_entities(texts, names, all_rows=True))


def test_very_long_pieces():
    for text in ("x" * 300_000 + " at 5", "a-" * 100_000 + " at 5 ", "1" * 200_000, "1 " * 50_000, "a.b" * 60_000 + " at 1", "." * 200_000 + " at 1"):
        assert pii.find(text, NAMES) == []
