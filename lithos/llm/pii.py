"""Personal data by candidate gradient boosting, in DataFrame functions only.

* Base patterns find e-mail addresses, IPs, cards and phone numbers with their format
  checks; what passes always stays.
* High-recall generators propose further, overlapping spans: looser e-mails, bare or
  grouped digit strings, numbers that a greedy base match swallowed together.
* Every proposal gets format features (digits, separators, checksums, parts) and context
  features (neighbouring characters, cue words).  Boosted trees score them, as plain CASE
  expressions.  They learn from all proposals: features are small whole numbers, so equal
  ones are counted together (``lessons``), and each level of a tree needs only the sums of
  gradients by node, feature and value.  The driver compares them; it adds them up itself
  where there are few distinct lessons, else a job does.
* Labels need no annotation.  A proposal that agrees with a base span is true; one that
  does not is taken for false, unless it lies inside a longer match that failed its check
  and may have swallowed it, which tells nothing.  Two forms are beyond the base patterns: e-mail addresses
  spelt out and phone numbers without their country.  They are taught by rewriting every
  base span of these kinds in its own context, which is true; false are those
  found after a word like "serial" or across a base span of another kind, and all others
  are left out: a number inside a base phone number is that number without its country.
* Per kind the threshold is calibrated on the quarter of the proposals that the trees do
  not see, for at least ``PRECISION``.  Accepted proposals that touch no other span are
  added.

Positions come from ``split`` and ``regexp_extract_all``: the lengths of the text between
matches and of the matches add up to code-point offsets, by a window over each document's
matches.  The patterns are the base patterns made linear: a look-behind (or \\G) anchors a
match to the start of its run of characters, and possessive loops never recurse.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.shared import settled

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
TREES, DEPTH, RATE = 24, 3, 0.3
#: Nodes of fewer proposals are leaves; a threshold needs so many true ones above it.
NODE_ROWS, TRUE_ROWS = 20, 5
#: Lengths and counts as features end here, so a level's sums are at most 4 * 17 * 256 rows.
MOST = 255
#: Gradients are added as multiples of 1 / UNIT, which gives the same trees in any order.
UNIT = 1 << 20
#: Scores are compared as multiples of 1 / STEPS between -SPAN and SPAN.
STEPS, SPAN = 128, 32
NEVER = 2**31 - 1
#: Up to so many lessons go to the driver; more stay in tasks of LESSONS_PER_PART.
LESSONS_HERE, LESSONS_PER_PART = 50_000, 20_000

#: (kind, base?, guard, pattern)
PATTERNS = (
    ("email", True, "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"),
    ("card", True, r"[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    ("phone", True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email", False, "@", r"""(?<![^\s<>()"',;:@])[^\s<>()"',;:@]++@[^\s<>()"',;:@]++"""),
    ("email", False, r"[\[(] ?at ?[\])]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]++)++"),
    ("ip", False, r"[0-9]\.[0-9]", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9.]*[0-9])"),
    ("card", False, r"[0-9]{14}", r"(?<![0-9])[0-9]{14,19}(?![0-9])"),
    ("card", False, r"[0-9]{4}[ -][0-9]{4}", r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{2,7}(?![0-9])"),
    ("phone", False, r"\+[0-9]", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("phone", False, r"[0-9][ .-][0-9]", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
_SPELT, _BARE = 5, 10
_CUES = r"(?i)(?:tel|phone|call|fax|mobile|card|visa|pay|mail|contact|addr|host|server)"
_DECOYS = r"(?i)(?:version|release|licen[cs]e|section|chapter|build|isbn|serial)"


def _bound(c: Column, use) -> Column:
    """use(c) with c computed once."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _found(text: Column, gen: int, guard: str, pattern: str) -> Column:
    """array<struct<gen, i, gap, m, before, after>> of one pattern's matches."""
    likely = F.contains(text, F.lit(guard)) if guard == "@" else text.rlike(guard)
    # Bound once by the outer lambda: an expression inside the inner one would run again for every match.
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    made = _bound(
        both,
        lambda b: F.transform(
            b["found"],
            lambda m, i: F.struct(
                F.lit(gen).alias("gen"),
                i.alias("i"),
                F.length(F.get(b["pieces"], i)).alias("gap"),
                m.alias("m"),
                F.right(F.get(b["pieces"], i), F.lit(24)).alias("before"),
                F.left(F.get(b["pieces"], i + 1), F.lit(8)).alias("after"),
            ),
        ),
    )
    none = F.expr("cast(array() as array<struct<gen:int,i:int,gap:int,m:string,before:string,after:string>>)")
    return F.when(likely, made).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits of m (14 to 19 of them) pass the Luhn check."""
    def total(d: Column) -> Column:
        one = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        step = lambda acc, i: acc + F.when(i % 2 == 1, one(i)).when(one(i) > 4, one(i) * 2 - 9).otherwise(one(i) * 2)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step)

    return F.when(F.length(_digits(m)).between(14, 19), _bound(F.reverse(_digits(m)), total) % 10 == 0).otherwise(F.lit(False))


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _features() -> dict[str, Column]:
    m, before, after = F.col("m"), F.col("before"), F.col("after")
    length = lambda c: F.least(F.length(c), F.lit(MOST))
    count = lambda pattern: length(F.regexp_replace(m, f"[^{pattern}]", ""))
    edge = lambda c: F.when(F.length(c) == 0, 0).when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike(r"\s"), 1).otherwise(3)
    return {
        "kind_no": F.col("kind_no"),
        "size": length(m),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "dots": count("."),
        "spaces": count(" "),
        "dashes": count(r"\-"),
        "brackets": count("()"),
        "plus": F.when(F.startswith(m, F.lit("+")), 1).otherwise(0),
        "at": count("@"),
        "ending": length(F.regexp_extract(m, r"\.([A-Za-z]+)$", 1)),
        "luhn": F.when(_luhn(m), 1).otherwise(0),
        "parts": F.when((F.col("kind_no") == 1) & _ip_ok(m), 1).otherwise(0),
        "left": edge(F.right(before, F.lit(1))),
        "right": edge(F.left(after, F.lit(1))),
        "cue": F.when(before.rlike(_CUES), 1).otherwise(0),
        "decoy": F.when(before.rlike(_DECOYS), 1).otherwise(0),
    }


def _expression(tree, names: list[str]) -> str:
    if isinstance(tree, float):
        return f"{tree * RATE!r}D"
    f, t, a, b = tree
    return f"CASE WHEN {names[f]} <= {t!r}D THEN {_expression(a, names)} ELSE {_expression(b, names)} END"


def _score(trees: list, names: list[str]) -> Column:
    return F.expr(" + ".join(_expression(t, names) for t in trees)) if trees else F.lit(0.0)


def _mark(score: Column) -> Column:
    return F.floor(F.greatest(F.least(score, F.lit(float(SPAN))), F.lit(float(-SPAN))) * STEPS).cast("int")


def lessons(told: DataFrame, names: list[str]) -> DataFrame:
    """One row per distinct features of ``told`` (names, agrees, aside): how many the trees see (n) and how many of these are true (y), the same of those kept aside."""
    seen, true = F.when(F.col("aside"), 0).otherwise(1), F.col("agrees").cast("bigint")
    sums = {"n": seen, "y": seen * true, "n_aside": 1 - seen, "y_aside": (1 - seen) * true}
    return told.groupBy(*names).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def _best(cells: np.ndarray) -> tuple[float, tuple | None]:
    """The leaf value of a node, and its best split (feature, threshold, value left, value right), from rows (feature, value, n, g, h)."""
    leaf = lambda g, h: float(-g / (h + 1.0))
    n, g, h = (cells[cells[:, 0] == 0][:, k].sum() for k in (2, 3, 4))
    g, h = g / UNIT, h / UNIT
    best, split = 1e-3, None
    for f in np.unique(cells[:, 0]) if n >= NODE_ROWS else ():
        own = cells[cells[:, 0] == f]
        own = own[np.argsort(own[:, 1])]
        a, b = np.cumsum(own[:, 3])[:-1] / UNIT, np.cumsum(own[:, 4])[:-1] / UNIT  # every threshold
        if len(a):
            gain = a**2 / (b + 1.0) + (g - a) ** 2 / (h - b + 1.0) - g**2 / (h + 1.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, split = float(gain[k]), (int(f), float(own[k, 1]), leaf(a[k], b[k]), leaf(g - a[k], h - b[k]))
    return leaf(g, h), split


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree * RATE)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, _apply(a, x), _apply(b, x))


def _sums_here(counted: DataFrame, names: list[str]):
    """As _sums_by_jobs, of lessons that are collected once (at most LESSONS_HERE rows)."""
    rows = np.array([tuple(r) for r in counted.filter("n > 0").select(*names, "n", "y").collect()], dtype=np.int64).reshape(-1, len(names) + 2)
    x, n, y = rows[:, :-2], rows[:, -2], rows[:, -1]

    def sums(trees: list, splits: dict, open_: list) -> np.ndarray:
        p = 1 / (1 + np.exp(-sum((_apply(t, x) for t in trees), np.zeros(len(x)))))
        g, h = (np.floor(c * UNIT + 0.5).astype(np.int64) for c in (n * p - y, n * p * (1 - p)))
        node = np.ones(len(x), dtype=np.int64)
        for k in sorted(splits):  # parents first
            f, t, *_ = splits[k]
            node = np.where(node == k, 2 * k + (x[:, f] > t), node)
        out = []
        for k in open_:
            at = node == k
            for f in range(len(names)):
                cells = np.zeros((MOST + 1, 3), dtype=np.int64)
                np.add.at(cells, x[at, f], np.stack([n, g, h], axis=1)[at])
                v = np.flatnonzero(cells[:, 0])
                out.append(np.column_stack([np.full(len(v), k), np.full(len(v), f), v, cells[v]]))
        return np.concatenate(out)

    return sums


def _sums_by_jobs(counted: DataFrame, names: list[str]):
    """sums(trees, splits, open nodes): rows (node, feature, value, n, g, h) of all lessons in open nodes, added up by a job."""

    def place(splits: dict, open_: list, k: int) -> str:
        if k in splits:
            return f"CASE WHEN {names[splits[k][0]]} <= {splits[k][1]!r}D THEN {place(splits, open_, 2 * k)} ELSE {place(splits, open_, 2 * k + 1)} END"
        return str(k) if k in open_ else "CAST(NULL AS INT)"

    def sums(trees: list, splits: dict, open_: list) -> np.ndarray:
        p = F.col("p")
        graded = counted.filter("n > 0").withColumn("p", 1 / (1 + F.exp(-_score(trees, names))))
        g, h = (F.floor(c * UNIT + 0.5).cast("bigint") for c in (F.col("n") * p - F.col("y"), F.col("n") * p * (1 - p)))
        at = graded.select(F.expr(place(splits, open_, 1)).alias("node"), "n", g.alias("g"), h.alias("h"), *names).filter("node is not null")
        cells = at.select("node", "n", "g", "h", F.posexplode(F.array(*names)).alias("f", "v"))
        found = cells.groupBy("node", "f", "v").agg(F.sum("n"), F.sum("g"), F.sum("h")).collect()  # at most 4 * 17 * 256 rows
        return np.array([tuple(r) for r in found], dtype=np.int64).reshape(-1, 6)

    return sums


def grow(sums, trees: list):
    """The next regression tree on the gradients of all lessons: a leaf value, or (feature, threshold, left, right).

    It grows by levels; the children of node k are 2 k and 2 k + 1.
    """
    splits, leaves, open_ = {}, {}, [1]
    for depth in range(DEPTH, 0, -1):
        found = sums(trees, splits, open_)
        for k in open_:
            value, split = _best(found[found[:, 0] == k][:, 1:])
            if split is None:
                leaves[k] = value
            else:
                splits[k] = split
                if depth == 1:
                    leaves[2 * k], leaves[2 * k + 1] = split[2:]
        open_ = [c for k in open_ if k in splits for c in (2 * k, 2 * k + 1) if c not in leaves]
        if not open_:
            break
    built = lambda k: (*splits[k][:2], built(2 * k), built(2 * k + 1)) if k in splits else leaves[k]
    return built(1)


def fit(counted: DataFrame, names: list[str]) -> tuple[list, list[int]]:
    """Trees, and per kind the least mark to accept (NEVER: accept none), from all lessons."""
    counted = settled(counted)
    rows = counted.count()
    if not rows:
        return [], [NEVER] * len(KINDS)
    counted = counted.coalesce(1 + rows // LESSONS_PER_PART)  # few rows in few tasks; the count never grows
    sums = (_sums_here if rows <= LESSONS_HERE else _sums_by_jobs)(counted, names)
    trees: list = []
    for _ in range(TREES):
        trees.append(grow(sums, trees))
    kept = counted.filter("n_aside > 0").select("kind_no", _mark(_score(trees, names)).alias("mark"), "n_aside", "y_aside")
    marks = kept.groupBy("kind_no", "mark").agg(F.sum("n_aside").alias("n"), F.sum("y_aside").alias("y")).collect()  # at most 4 * (2 * SPAN * STEPS + 1) rows
    cuts = []
    for k in range(len(KINDS)):
        own = sorted(((r["mark"], r["n"], r["y"]) for r in marks if r["kind_no"] == k), reverse=True)
        n, y = (np.cumsum([r[i] for r in own]) for i in (1, 2))
        good = [r[0] for r, a, b in zip(own, n, y, strict=True) if b >= max(TRUE_ROWS, PRECISION * a)]
        cuts.append(max(0, good[-1]) if good else NEVER)
    return trees, cuts


def rewritten(m: Column, kind_no: Column) -> Column:
    """A base e-mail address or phone number in a form that only the generators know; null where it has none."""
    form = F.pmod(F.xxhash64(m), F.lit(3))
    at, dot = (F.when(form == 0, f" [{w}] ").when(form == 1, f" ({w}) ").otherwise(f"[{w}]") for w in ("at", "dot"))
    dot = F.when(F.length(m) % 2 == 0, dot).otherwise(".")
    spelt = F.concat(F.substring_index(m, "@", 1), at, F.replace(F.substring_index(m, "@", -1), F.lit("."), dot))
    bare = F.regexp_extract(m, r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", 0)
    whole = lambda c, k: F.when(c.rlike(f"^(?:{PATTERNS[k][3]})$"), c)
    return F.when(kind_no == 0, whole(spelt, _SPELT)).when(kind_no == 3, whole(bare, _BARE))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and the digest are of base spans; ``spans`` also has the added ones, each as
    kind:start:end in code points, end exclusive.  Null and empty texts have none.  Rows
    are taken one by one, so repeated ids and texts make no difference.  Spans that begin and end alike are listed once a kind, by
    start, then kind.  A text of any length is one unit of a task's memory.  Other columns
    are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    every = F.concat(*[_found(F.col("text"), k, guard, pattern) for k, (_, _, guard, pattern) in enumerate(PATTERNS)])
    hits = rows.select("id", "row", F.inline_outer(every)).repartition("row")
    before = Window.partitionBy("row", "gen").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("m")
    start = F.coalesce(F.sum(F.col("gap").cast("bigint") + size).over(before), F.lit(0)) + F.col("gap")
    kind_of = F.element_at(F.array(*[F.lit(KINDS.index(k)) for k, *_ in PATTERNS]), F.col("gen") + 1)
    base_of = F.col("gen") < sum(base for _, base, *_ in PATTERNS)
    hits = hits.withColumn("start", start).withColumn("end", F.col("start") + size).withColumn("kind_no", kind_of).withColumn("base", base_of)
    digits = F.length(_digits(F.col("m")))
    valid = (
        F.when(F.col("kind_no") == 0, F.lit(True))
        .when(F.col("kind_no") == 1, _ip_ok(F.col("m")))
        .when(F.col("kind_no") == 2, _luhn(F.col("m")))
        .otherwise(digits.between(10, 15))
    )
    # One row stays for a document without any span; failing base matches go.
    hits = hits.withColumn("base", F.when(F.col("gen").isNull(), F.lit(None)).otherwise(F.col("base") & valid))
    hits = hits.withColumn("dud", (F.col("gen") < sum(base for _, base, *_ in PATTERNS)) & ~F.col("base"))
    features = _features()
    names = list(features)
    # A proposal agrees with a base span of its kind, or touches one of any kind.
    span = Window.partitionBy("row", "kind_no", "start", "end")
    along = Window.partitionBy("row").orderBy("start", "end", "gen")
    hits = hits.withColumn("agrees", F.coalesce(F.max(F.col("base").cast("int")).over(span), F.lit(0)))
    around = Window.partitionBy("row", "kind_no").orderBy("start", F.desc("end"), "gen").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = F.max(F.col("gen") < sum(b for _, b, *_ in PATTERNS)).over(span)
    hits = hits.withColumn("swallowed", F.coalesce(~judged & (F.max(F.when(F.col("dud"), F.col("end"))).over(around) >= F.col("end")), F.lit(False)))
    hits = hits.withColumn("inside", F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(around) >= F.col("end"), F.lit(False)))
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(along.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    hits = hits.withColumn("free", (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end")))
    # A base span that has another form comes a second time, in that form, to be learnt from.
    told = F.when(F.col("base"), rewritten(F.col("m"), F.col("kind_no")))
    forms = F.filter(F.array(F.struct("m", F.lit(False).alias("taught")), F.struct(told.alias("m"), F.lit(True).alias("taught"))), lambda x: ~x["taught"] | x["m"].isNotNull())
    hits = hits.withColumn("forms", forms).drop("m").select("*", F.inline("forms"))
    hits = hits.select("id", "row", "gen", "kind_no", "start", "end", "base", "dud", "agrees", "free", "swallowed", "inside", "taught", *[c.alias(n) for n, c in features.items() if n != "kind_no"])
    hits = settled(hits)

    known = ~F.col("swallowed") & (~F.col("gen").isin(_SPELT, _BARE) | (~F.col("free") & ~F.col("inside")) | (F.col("decoy") == 1))
    proposed = F.col("taught") | (F.col("gen").isNotNull() & ~F.col("dud") & ~F.col("base") & known)
    aside = F.pmod(F.xxhash64("id", "kind_no", "start", "end"), F.lit(4)) == 0
    trees, cuts = fit(lessons(hits.filter(proposed).withColumn("aside", aside), names), names)
    hits = hits.filter(~F.col("taught"))
    cut = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("kind_no") + 1)
    added = ~F.col("base") & ~F.col("dud") & F.col("free") & (F.col("agrees") == 0) & (_mark(_score(trees, names)) >= cut)
    hits = hits.withColumn("added", F.coalesce(added, F.lit(False)))
    # Of accepted proposals that overlap, the first and longest stays.
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind_no", "gen").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("added"), F.col("end"))).over(order)
    hits = hits.withColumn("added", F.col("added") & (F.coalesce(reach, F.lit(-1)) <= F.col("start")))

    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1)
    entry = F.struct("start", "kind_no", F.concat_ws(":", kind, "start", "end").alias("text"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["text"]), ",")
    base = F.coalesce(F.col("base"), F.lit(False))
    out = hits.groupBy("row", "id").agg(
        *[F.count(F.when(base & (F.col("kind_no") == k), 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.collect_list(F.when(base, entry)).alias("bases"),
        F.collect_list(F.when(base | F.col("added"), entry)).alias("all"),
    )
    return out.select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("bases")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))
