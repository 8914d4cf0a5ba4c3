import pytest

from lectern.llm.names import assign, deletions, name_classes, name_pairs, osa, parse_name, same_entity


def test_parsing():
    assert parse_name("Dr. Jane Q.", "van Doe") == ("person", ["doe", "jane"], "q", [], "van")
    assert parse_name("JD", "Brik")[2] == "jd" and parse_name("J.D.", "Brik")[2] == "jd" and parse_name("J", "Brik")[2] == "j"
    assert parse_name(None, "Doe, Jane")[1] == ["doe", "jane"] == parse_name("Doe", "Jane")[1]
    assert parse_name("", "Popi Lab. Cart.")[0] == "org" and parse_name(None, "THE Popi Laboratory of Cartography")[1] == ["cartography", "laboratory", "popi"]
    assert parse_name(None, None) == ("person", [], "", [], "") and parse_name("", "  ")[1] == [] and parse_name("x" * 10_000, "y")[0] == "person"


def test_distances_and_assignment():
    assert (osa("abcd", "abdc"), osa("abc", "abcd"), osa("abc", "xyz"), osa("a" * 9, "a" * 4)) == (1, 1, 3, 3)
    assert assign(["popi", "lab", "cart"], ["cartography", "laboratory", "popi"], {"lab", "cart"}, set())[0] == pytest.approx(0.2)
    assert assign(["a", "b"], ["c", "d"], set(), set())[0] == float("inf")
    assert "gerak" in deletions("vangerak")


ROWS = [
    (1, "Frederick", "Binderima"), (2, "F.", "BINDERIMA"), (3, "Binderima", "Frederick"), (4, None, "Binderima, Frederick"), (5, "Fritz", "Binderima"), (6, "Frederick", "Bindreima"),
    (7, "Frederick", "Binderima"), (10, "Helga", "Binderima"), (11, "Matthias K.", "de Fondugan"), (12, "Matthias", "Fondugan"), (13, "M. K.", "Fondugan"), (14, "Matthias W.", "Fondugan"),
    (20, None, "Popiholm Laboratory of Cartography"), (21, None, "Lab. of Cartography, Popiholm"), (22, "Popiholm", "Laboratory of Cartography"), (23, None, "Popiholm Museum of Cartography"),
    (24, None, "Popiholm Laboratory of Csrtography"), (30, None, None), (31, "", ""), (32, "X", None), (2, "F.", "BINDERIMA"),
]


def test_classes(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "creator_id bigint, first_name string, last_name string, class_id string")
    got = {r["creator_id"]: r["class_id"] for r in name_classes(df, {"fritz": "frederick"}).collect()}
    assert len({got[i] for i in (1, 2, 3, 4, 5, 6, 7)}) == 1 and got[10] != got[1]
    assert got[11] == got[12] or got[14] == got[12]
    assert got[13] == got[11] and got[11] != got[14] or got[12] in (got[11], got[14])
    assert got[20] == got[21] == got[22] == got[24] != got[23]
    assert set(got) == {r[0] for r in ROWS}


def test_pairs_equal_the_classes_and_empty_input_works(spark):
    df = spark.createDataFrame(ROWS[:8], "creator_id bigint, first_name string, last_name string")
    pairs = {tuple(r) for r in name_pairs(df).collect()}
    assert (1, 2) in pairs and all(a < b for a, b in pairs) and len(pairs) == 15  # all but the nickname, which one surname can't teach
    assert name_pairs(df.limit(0)).count() == 0


def test_relatives_are_kept_apart():
    side = lambda *names, initials="": {"kind": "person", "names": sorted(names), "tokens": sorted(names), "initials": initials, "abbreviated": [], "spread": {n: 5 for n in names}}
    assert not same_entity(side("anna", "berg"), side("hanna", "berg"))
    assert not same_entity(side("anna", "berg", initials="q"), side("anna", "berg", initials="r"))
    assert same_entity(side("anna", "berg"), side("anna", "berg", initials="r"))


def test_long_names_are_assigned_whole():
    """More tokens than any table of subsets could hold: every token counts."""
    tokens = [f"token{c}" for c in "abcdefghijklmn"]
    slip = [*tokens[:13], "tokenq"]
    assert assign(tokens, slip[::-1], set(), set())[0] == 1 and assign(tokens, [*tokens[:12], "other", "words"], set(), set())[0] == float("inf")


def test_nicknames_are_learned_and_lone_names_linked(spark):
    surnames = ["Arnoldi", "Bertram", "Carlsen", "Dorval", "Ekman", "Fontane", "Grieg", "Hansard"]
    rows = [(i, "Margaret", s) for i, s in enumerate(surnames)] + [(20 + i, "Peggy", s) for i, s in enumerate(surnames[:4])] + [(40, None, "Sostimarch"), (41, None, "Sostimrach"), (42, None, "Berg"), (43, None, "Burg")]
    got = {r["creator_id"]: r["class_id"] for r in name_classes(spark.createDataFrame(rows, "creator_id bigint, first_name string, last_name string")).collect()}
    assert all(got[20 + i] == got[i] for i in range(4)) and got[40] == got[41] and got[42] != got[43]
    assert len({got[i] for i in range(8)}) == 8


def test_a_surname_of_very_many_given_names(spark):
    """A nickname is found though one of its surnames stands with hundreds of given names, and no other is taken for one."""
    from lectern.llm.names import learn_nicknames

    surnames = ["arnoldi", "bertram", "carlsen", "dorval", "ekman", "fontane", "grieg", "hansard", "iversen", "jansson"]
    pairs = {("margaret", s) for s in [*surnames, "smith"]} | {("peggy", s) for s in [*surnames[:4], "smith"]} | {(f"given{i}q", "smith") for i in range(400)}
    units = spark.createDataFrame([("person", sorted(p)) for p in pairs], "kind string, tokens array<string>")
    assert {tuple(r) for r in learn_nicknames(units).collect()} == {("peggy", "margaret")}
