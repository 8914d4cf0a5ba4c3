"""A misspelling that recurs with many surnames against two names that are alike."""

from lectern.llm.names import name_classes


HEADS = ("Bra", "Cle", "Dro", "Fu", "Gi", "Hel", "Jo", "Kvi", "Lum", "Mor")
SOME = [h + t for t in ("nkstein", "vadimov", "pperlow", "tzgarth") for h in HEADS]
OTHERS = [h + t for t in ("bulgrim", "ckwefield", "shtokay", "zzonquil") for h in HEADS]


def _classes(spark, rows):
    df = spark.createDataFrame([(i, f, s) for i, (f, s) in enumerate(rows)], "creator_id bigint, first_name string, last_name string")
    got = {r["creator_id"]: r["class_id"] for r in name_classes(df).collect()}
    return {row: got[i] for i, row in enumerate(rows)}


def test_a_recurring_misspelling_is_linked(spark):
    # 'Elesnor' stands with four surnames, with one of them 'Eleanor' is missing; 'Bneedict' with nine, two missing
    rows = [("Eleanor", s) for s in SOME[1:25]] + [("Elesnor", s) for s in SOME[:4]]
    rows += [("Benedict", s) for s in OTHERS[2:40]] + [("Bneedict", s) for s in OTHERS[:9]]
    got = _classes(spark, rows)
    assert all(got["Elesnor", s] == got["Eleanor", s] for s in SOME[1:4])
    assert all(got["Bneedict", s] == got["Benedict", s] for s in OTHERS[2:9])
    assert len(set(got.values())) == 24 + 1 + 38 + 2


def test_established_names_stay_apart(spark):
    # of like spread and sharing many surnames; far rarer, but sharing only one of four
    rows = [("Anna", s) for s in SOME[:20]] + [("Hanna", s) for s in SOME[10:22]]
    rows += [("Marian", s) for s in OTHERS[:30]] + [("Marion", s) for s in OTHERS[29:33]]
    got = _classes(spark, rows)
    assert len(set(got.values())) == len(rows)
