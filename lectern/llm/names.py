"""Linking the spellings of one person or organisation.

1. *Tokens.* A spelling is cut into folded tokens: titles, suffixes and particles
   are set aside, single letters and blocks of capitals become initials, full stops
   mark abbreviations. Field and order of the parts play no role from here on.
2. *Units.* Spellings of the same tokens are one unit; all later work is between units.
3. *Nicknames.* A short form is learned as another form of a name when nearly all
   the surnames it stands with also stand with that name; none is built in.
4. *Neighbourhood index.* A unit of two or more full tokens is entered under every
   (token, deletion of another token) pair - the symmetric-delete neighbourhood at
   distance one; a single token of six letters or more under its own deletions; organisations under (deletion of a token, initials of the others).
   Units that meet are compared by optimal assignment of their tokens, which allows
   equal tokens, nicknames, one typing error, abbreviations and initials, and
   refuses contradicting initials, and two names that are both established. A
   misspelling that recurs isn't a name of its own, however often it stands: it is
   far rarer than the name and mostly stands with others that the name stands with.
5. *Classes.* Accepted pairs are closed to classes by label propagation.
6. *Initials.* A unit of a surname and initials joins the class of its surname that
   the initials fit; of several the one with the same second initial, then the one
   with most spellings.

Everything is joined on keys of single units or token pairs; nothing is broadcast
and no group of rows is gathered in one task.

Defined results: a spelling without a letter or digit is a class of its own, as is
one of a single short token; spellings two typing errors apart are linked only over a third between them; rows with equal names but different ids are linked; repeated rows
of an id count once; null fields are empty; over-long names are treated alike.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.session import materialize

# Words around a name that are not part of it.
TITLES = frozenset("dr prof professor mr mrs sir dame rev fr".split())
SUFFIXES = frozenset("jr sr ii iii iv phd esq".split())
PARTICLES = frozenset("van von de da di del della der den des do dos du la le lo ten ter te zu zum zur af av al el bin ibn".split())
GLUE = frozenset("of the for and in at et und fur für y".split())
# Kinds of organisation.
KINDS = frozenset(
    "university college academy school faculty department institute institution laboratory centre center museum library archive archives observatory "
    "society association commission committee council foundation trust agency office ministry bureau company corporation group union federation press hospital clinic".split()
)
PARSED = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.StringType())),  # full tokens, sorted
    T.StructField("initials", T.StringType()),  # in their order
    T.StructField("abbreviated", T.ArrayType(T.StringType())),  # tokens written with a full stop
    T.StructField("particle", T.StringType()),
])


#: Letters from which a name of one token is compared with others of one token.
LONE = 6


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text.casefold().replace("ø", "o").replace("đ", "d").replace("ł", "l").replace("æ", "ae").replace("œ", "oe")


def parse_name(first: str | None, last: str | None) -> tuple[str, list[str], str, list[str], str]:
    """(kind, full tokens, initials, abbreviated tokens, particle) of a spelling."""
    raw = [w for w in re.split(r"[\s,;/]+|(?<=[^\W\d_]\.)(?=[^\W\d_])", f"{first or ''} {last or ''}") if w]
    whole = f"{first or ''} {last or ''}"
    shouted = whole.upper() == whole
    words = [(w, fold(re.sub(r"[^\w'’-]", "", w)).strip("'’-_")) for w in raw]
    words = [(w, f) for w, f in words if f]
    org = any(f in KINDS for _, f in words) or (any(f == "of" for _, f in words) and len(words) > 2) or sum(w.endswith(".") and len(f) > 2 and f not in TITLES and f not in SUFFIXES for w, f in words) >= 2
    if org:
        tokens = [f for _, f in words if f not in GLUE]
        short = [f for w, f in words if w.endswith(".") and f not in GLUE]
        return "org", sorted(set(tokens)), "", sorted(set(short)), ""
    tokens, initials, particle = [], "", ""
    for w, f in words:
        if f in SUFFIXES and len(words) > 1 and not (w.isupper() and w.isalpha() and len(w) == 2 and not shouted):
            continue
        if f in TITLES and len(words) > 2:
            continue
        if f in PARTICLES and len(words) > 1 and (not w.isupper() or shouted or any(o.isupper() and len(o) > 3 for o, _ in words)):
            particle += f
            continue
        if len(f) == 1:
            initials += f
        elif len(f) <= 3 and w.isupper() and not shouted and w.isalpha():  # initials run together
            initials += f
        elif len(f) == 2 and w.isupper() and w.isalpha() and not re.search("[aeiouy]", f):
            initials += f
        else:
            tokens.append(f)
    return "person", sorted(set(tokens)), initials, [], particle


@lru_cache(maxsize=1 << 16)
def osa(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours counted once; above 2 reported as 3."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return min(3, row[-1])


def variants(token: str) -> list[str]:
    """A token, and without a particle that was written on to it."""
    out = [token]
    for p in PARTICLES:
        if len(p) > 1 and token.startswith(p) and len(token) - len(p) >= 5:
            out.append(token[len(p) :])
    return out


def token_cost(a: str, b: str, short_a: bool, short_b: bool) -> float:
    """0 for equal tokens, 0.1 for an abbreviation, 1 for a typing error, else infinite."""
    if a == b:
        return 0.0
    if short_a and len(a) > 1 and b.startswith(a) or short_b and len(b) > 1 and a.startswith(b):
        return 0.1
    if min(len(a), len(b)) >= 3 and min(osa(x, y) for x in variants(a) for y in variants(b)) <= 1:
        return 1.0
    return float("inf")


def assign(a: list[str], b: list[str], short_a: set[str], short_b: set[str]) -> tuple[float, list[tuple[str, str]]]:
    """The least total cost of matching every token of the shorter name to one of the longer, and the matches."""
    if len(a) > len(b):
        a, b, short_a, short_b = b, a, short_b, short_a
    # equal tokens first: an exchange of partners never makes them cheaper
    pairs, rest = [], list(b)
    left = []
    for x in a:
        if x in rest:
            rest.remove(x)
            pairs.append((x, x))
        else:
            left.append(x)
    if not left:
        return 0.0, pairs
    costs = [[token_cost(x, y, x in short_a, y in short_b) for y in rest] for x in left]
    if any(min(row) == float("inf") for row in costs):
        return float("inf"), []
    total, match = least_assignment(costs)
    return total, pairs + [(left[i], rest[j]) for i, j in enumerate(match)] if total < float("inf") else []


def least_assignment(costs: list[list[float]]) -> tuple[float, list[int]]:
    """(total, column of each row) of the cheapest assignment of all rows to different columns, by augmenting along
    shortest paths over potentials: cubic in the number of rows, at any number."""
    big = 1e6
    n, m = len(costs), len(costs[0])
    u, v = [0.0] * (n + 1), [0.0] * (m + 1)
    owner = [0] * (m + 1)  # row (from 1) of each column
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        slack, via, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[j0] = True
            row, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    reduced = min(costs[row - 1][j - 1], big) - u[row] - v[j]
                    if reduced < slack[j]:
                        slack[j], via[j] = reduced, j0
                    if slack[j] < delta:
                        delta, j1 = slack[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    slack[j] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0] = owner[via[j0]]
            j0 = via[j0]
    match = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            match[owner[j] - 1] = j - 1
    return sum(costs[i][j] for i, j in enumerate(match)), match


def deletions(token: str) -> set[str]:
    out = set()
    for v in variants(token):
        out.add(v)
        if len(v) >= 3:
            out |= {v[:i] + v[i + 1 :] for i in range(len(v))}
    return out


def same_entity(a: dict, b: dict) -> bool:
    """Whether two units of full tokens are spellings of one person or organisation."""
    if a["kind"] != b["kind"]:
        return False
    if a["kind"] == "org":
        if len(a["tokens"]) != len(b["tokens"]):
            return False
        cost, _ = assign(a["tokens"], b["tokens"], set(a["abbreviated"]), set(b["abbreviated"]))
        return cost < 2
    if len(a["names"]) != len(b["names"]):
        return False
    cost, pairs = assign(a["names"], b["names"], set(), set())
    if cost >= 2:
        return False
    if a["initials"] and b["initials"] and a["initials"] != b["initials"]:
        return False
    slips = {*a.get("slips", ()), *b.get("slips", ())}
    for x, y in pairs:
        if x != y and min(a["spread"].get(x, 0), b["spread"].get(y, 0)) >= 3 and not {f"{x}|{y}", f"{y}|{x}"} & slips:
            return False  # both stand with several other names: two names, not one and its misspelling
    return True


def _lone(names: list[str]) -> list[str]:
    """Keys of a name of one token: its neighbourhood, if it is long enough for one typing error to leave it recognisable."""
    return sorted({f"|{d}" for t in names if len(t) >= LONE for d in deletions(t)})


def _keys(kind: str, names: list[str]) -> list[str]:
    if kind == "org":
        if len(names) < 2:
            return _lone(names)
        return sorted({d + "|" + "".join(sorted(o[0] for o in names if o != t)) for t in names for d in deletions(t)})
    if len(names) < 2:
        return _lone(names)
    return sorted({f"{v}|{d}" for t in names for v in variants(t) for u in names if u != t for d in deletions(u)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def keys_udf(kind: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([_keys(k, list(n)) for k, n in zip(kind, names, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def deletions_udf(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: sorted(deletions(t)))


def _parse(first: pd.Series, last: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(f, n) for f, n in zip(first, last, strict=True)], columns=PARSED.names)


def learn_nicknames(units: DataFrame, least: int = 3, share: float = 0.8, wide_from: int = 6) -> DataFrame:
    """(short, name): a token that nearly always shares its other tokens with one more widespread token.

    The widespread one stands with ``wide_from`` others or more, as given names do,
    and what the two share begins in different ways (so isn't one word and its misspellings).
    """
    pairs = units.where("kind = 'person' and size(tokens) = 2").select("tokens").distinct()
    ends = pairs.select(F.col("tokens")[0].alias("t"), F.col("tokens")[1].alias("o")).unionByName(
        pairs.select(F.col("tokens")[1].alias("t"), F.col("tokens")[0].alias("o"))
    ).distinct()
    spread = ends.groupBy("t").agg(F.count("*").alias("n"))
    ends = materialize(ends.join(spread, "t"))
    # a name with `share` of a short form's partners has one of its rarest ones: only those are looked up, so that a
    # surname of very many given names is met by few of them
    heat = ends.groupBy("o").agg(F.count("*").alias("heat"))
    rarest = Window.partitionBy("t").orderBy("heat", "o")
    first = ends.where(F.col("n") >= least).join(heat, "o").withColumn("place", F.row_number().over(rarest))
    first = first.where(F.col("place") <= F.col("n") - F.ceil(F.lit(share) * F.col("n")) + 1).select(F.col("t").alias("short"), "o", F.col("n").alias("n_short"))
    wide = ends.where(F.col("n") >= wide_from).select(F.col("t").alias("name"), "o", F.col("n").alias("n_name"))
    near = first.join(wide, "o").where("short != name").where(F.col("n_name") >= 2 * F.col("n_short")).select("short", "name", "n_short", "n_name").distinct()
    shared = near.join(ends.select(F.col("t").alias("short"), "o"), "short").join(wide.select("name", "o"), ["name", "o"], "left_semi")
    both = (
        shared.groupBy("short", "name", "n_short", "n_name")
        .agg(F.count("*").alias("both"), F.countDistinct(F.substring("o", 1, 2)).alias("heads"))
        .where((F.col("both") >= least) & (F.col("heads") >= 2) & (F.col("both") >= share * F.col("n_short")))
    )
    return both.groupBy("short").agg(F.max_by("name", F.struct("both", "n_name", "name")).alias("name"))


@F.pandas_udf(T.BooleanType())
def one_edit_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_cost(x, y, False, False) == 1 for x, y in zip(a, b, strict=True)], dtype=bool)


def recurring_slips(ends: DataFrame, spread: DataFrame, ratio: float = 4, share: float = 0.5) -> DataFrame:
    """(slip, name): established tokens one edit apart of which one is a misspelling of the other.

    ``ends`` has every token ``t`` with every other ``o`` it stands with, ``spread`` their number.
    The name stands with ``ratio`` times as many others, and with at least ``share`` of the slip's.
    """
    keyed = ends.join(spread.where("n >= 3"), "t").select("t", "o", "n", F.explode(deletions_udf("t")).alias("key"))
    slip = keyed.select(F.col("t").alias("slip"), "o", F.col("n").alias("n_slip"), "key")
    name = keyed.select(F.col("t").alias("name"), "o", F.col("n").alias("n_name"), "key")
    both = slip.join(name, ["o", "key"]).where(F.col("n_name") >= ratio * F.col("n_slip")).select("slip", "name", "n_slip", "o").distinct()
    both = both.groupBy("slip", "name", "n_slip").agg(F.count("*").alias("both")).where(F.col("both") >= share * F.col("n_slip"))
    return both.where(one_edit_udf("slip", "name")).select("slip", "name")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by label propagation with pointer jumping."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = materialize(nodes.select("node", F.col("node").alias("label")).distinct())
    while True:  # labels only fall, so it ends; jumping over labels halves what is left of a chain
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        up = step.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        after = materialize(step.join(up, "new", "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("label"), (F.col("label") != F.least("new", F.coalesce("jump", "new"))).alias("moved")))
        moved = after.where("moved").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels


def name_classes(creators: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(creator_id, class_id): spellings of one person or organisation share the class.

    ``nicknames``: short forms known beforehand; all others, and by default all, are learned from the table.
    """
    parse = F.pandas_udf(_parse, PARSED)
    rows = creators.where("creator_id is not null").select("creator_id", parse("first_name", "last_name").alias("p")).select("creator_id", "p.*")
    shape = ["kind", "tokens", "initials", "abbreviated"]
    parsed = materialize(rows.select("creator_id", *shape))
    units = materialize(parsed.groupBy(*shape).agg(F.min("creator_id").alias("unit"), F.count("*").alias("spellings")))
    # names with the short forms put back
    given = creators.sparkSession.createDataFrame(sorted((nicknames or {}).items()), "short string, name string")
    learned = learn_nicknames(units).join(given, "short", "left_anti")
    nick = given.unionByName(learned)
    full = units.where("kind = 'person'").select("unit", F.explode("tokens").alias("short")).join(nick, "short", "left")
    named = full.groupBy("unit").agg(F.array_sort(F.collect_set(F.coalesce("name", "short"))).alias("names"))
    units = units.join(named, "unit", "left").withColumn("names", F.coalesce("names", "tokens"))
    # with how many other names each name stands
    ends = units.where("kind = 'person' and size(names) = 2").select(F.explode(F.array(F.struct(F.col("names")[0].alias("t"), F.col("names")[1].alias("o")), F.struct(F.col("names")[1].alias("t"), F.col("names")[0].alias("o")))).alias("e")).select("e.*").distinct()
    ends = materialize(ends)
    spread = ends.groupBy("t").agg(F.count("*").alias("n"))
    per_unit = units.select("unit", F.explode("names").alias("t")).join(spread, "t").groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("spread"))
    slips = recurring_slips(ends, spread).select(F.col("slip").alias("t"), F.concat_ws("|", "slip", "name").alias("slip"))
    slips = units.select("unit", F.explode("names").alias("t")).join(slips, "t").groupBy("unit").agg(F.collect_set("slip").alias("slips"))
    units = materialize(units.join(per_unit, "unit", "left").join(slips, "unit", "left"))

    keyed = units.select("unit", F.explode(keys_udf("kind", "names")).alias("key"))
    meet = keyed.select(F.col("unit").alias("a"), "key").join(keyed.select(F.col("unit").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    body = F.struct("kind", "tokens", "names", "initials", "abbreviated", "spread", "slips")
    sides = units.select("unit", body.alias("u"))
    compared = meet.join(sides.select(F.col("unit").alias("a"), F.col("u").alias("ua")), "a").join(sides.select(F.col("unit").alias("b"), F.col("u").alias("ub")), "b")

    def accept(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        return pd.Series([same_entity(_side(p), _side(q)) for p, q in zip(x.to_dict("records"), y.to_dict("records"), strict=True)])

    links = compared.where(F.pandas_udf(accept, T.BooleanType())("ua", "ub")).select("a", "b")
    labels = connected(units.select(F.col("unit").alias("node")), links)
    classed = units.join(labels, units["unit"] == labels["node"]).drop("node")
    return _attach_initials(parsed, materialize(classed), shape)


def _side(unit: dict) -> dict:
    spread = unit["spread"]
    spread = dict(spread) if spread is not None else {}
    slips = unit["slips"]
    slips = list(slips) if slips is not None else []
    return {**unit, "tokens": list(unit["tokens"]), "names": list(unit["names"]), "abbreviated": list(unit["abbreviated"]), "spread": spread, "slips": slips}


def _attach_initials(parsed: DataFrame, classed: DataFrame, shape: list[str]) -> DataFrame:
    """Classes with the units of one full token and initials attached where they fit."""
    person = classed.where("kind = 'person'")
    weak = person.where("size(names) = 1 and initials != ''").select("unit", F.col("names")[0].alias("surname"), "initials")
    strong = person.where("size(names) >= 2")
    # per class: each (surname, first letter of another name), the second initials seen and the number of spellings
    forms = strong.select("label", "spellings", "initials", F.explode("names").alias("surname"), "names")
    forms = forms.select("label", "spellings", "surname", "initials", F.explode("names").alias("other")).where("other != surname")
    forms = forms.groupBy("label", "surname", F.substring("other", 1, 1).alias("letter")).agg(
        F.sum("spellings").alias("spellings"), F.max("initials").alias("middle")
    )
    left = weak.select("unit", "surname", F.substring("initials", 1, 1).alias("letter"), F.expr("substring(initials, 2)").alias("rest"), F.explode(deletions_udf("surname")).alias("key"))
    right = forms.select("label", F.col("surname").alias("full"), "letter", "spellings", "middle", F.explode(deletions_udf("surname")).alias("key"))
    near = left.join(right, ["key", "letter"]).drop("key").distinct()
    near = near.where((F.col("rest") == "") | (F.col("middle") == "") | F.col("middle").isNull() | (F.col("rest") == F.col("middle")))
    fit = F.struct(
        (F.col("full") == F.col("surname")).alias("exact"), ((F.col("rest") != "") & (F.col("rest") == F.col("middle"))).alias("same_middle"),
        "spellings", (-F.col("label")).alias("l"),
    )
    home = near.groupBy("unit").agg(F.max_by("label", fit).alias("home"))
    # initials without a class of full names: one class for each surname and first initial
    left_over = weak.join(home, "unit", "left_anti").select("unit", "surname", F.substring("initials", 1, 1).alias("letter"))
    own = left_over.groupBy("surname", "letter").agg(F.min("unit").alias("own"))
    alone = left_over.join(own, ["surname", "letter"]).select("own", "unit")
    final = classed.join(home, "unit", "left").join(alone, "unit", "left").select(*shape, F.coalesce("home", "own", "label").alias("class_id"))
    return parsed.join(final, shape).select("creator_id", "class_id").distinct()


def name_pairs(creators: DataFrame) -> DataFrame:
    """(creator_id_a, creator_id_b), a < b: all pairs of spellings of one person or organisation."""
    classes = materialize(name_classes(creators))
    x = classes.select("class_id", F.col("creator_id").alias("creator_id_a"))
    y = classes.select("class_id", F.col("creator_id").alias("creator_id_b"))
    return x.join(y, "class_id").where("creator_id_a < creator_id_b").select("creator_id_a", "creator_id_b").distinct()
