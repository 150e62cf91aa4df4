"""Personal data by candidate boosting: generators, boosted trees, calibrated thresholds. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, texts, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in a form that finds the same matches in linear time: possessive repeats where
#: nothing that follows could use what they give back, and no start inside a run whose start has
#: failed (``\G`` lets a match begin right behind the last one).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: spelled-out addresses, and any run of seven digits or more.
WIDE = {
    "address": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?+(?:@|[(\[]at[)\]])\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|[(\[]dot[)\]])\x20?+[A-Za-z0-9-]++)*+",
    "number": r"[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
}
CUE = r"(?i)(?:phone|tel|call|mobile|fax|card|visa|credit|iban|account|mail|contact|write|address|host|server|login|\bip\b)"
#: Contexts and forms that no personal data has: names and signs right before a number, calendar dates, four short groups between dots.
OTHER = r"(?i)(?:\b(?:ref|reference|order|ticket|invoice|isbn|issn|sku|serial|version|build|commit|hash)\b[\W_]{0,3}|[$€£¥#=/&_%])$"
DATE = r"^(?:(?:19|20)[0-9]{2}([-./ ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([-./ ])(?:0?[1-9]|[12][0-9]|3[01])\2(?:19|20)[0-9]{2})(?:[^0-9]|$)"
QUAD = r"^[0-9]+(?:\.[0-9]{1,3}){3}$"
LEFT, RIGHT = 24, 4
#: Candidates the trees are fitted to at most, about, before their forms; least share of personal data among as many labelled candidates of either kind above the threshold.
FIT_ROWS, PRECISION, LEAST_ROWS = 20_000, 0.95, 100
TREES, DEPTH, STEPS, SEED = 12, 3, 50, 5

FEATURES = ["digits", "groups", "first_group", "last_group", "longest_group", "kinds_of_digits", "first_zero", "check_digit", "address", "named", "domain", "top", "cue"]


def found(text: Column, pattern: str, gate: Column) -> Column:
    """Matches as array of (n, gap, value, left, right): the gap is the number of characters since the match before."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = "array<struct<gap:int,value:string,left:string,right:string>>"
    zipped = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(F.length(g).alias("gap"), v.alias("value"), F.right(g, F.lit(LEFT)).alias("left")))
    after = F.transform(F.slice(gaps, F.lit(2), F.size(values)), lambda g: F.left(g, F.lit(RIGHT)))
    both = F.zip_with(zipped, after, lambda a, r: F.struct(a["gap"].alias("gap"), a["value"].alias("value"), a["left"].alias("left"), r.alias("right")))
    return F.when(gate, both).otherwise(F.array().cast(kind))


def digits_of(value: str = "value") -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid() -> Column:
    """The base definition's checks on a base match."""
    digits = F.length(digits_of())
    part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255)
    small = F.forall(F.split("value", r"\."), part)
    return F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", small).when(F.col("kind") == "card", digits.between(13, 19) & luhn(F.right(digits_of(), F.lit(19)))).when(F.col("kind") == "phone", digits.between(9, 15)).otherwise(False)


def candidates(docs: DataFrame) -> DataFrame:
    """(rid, rth, kind, start, end, value, left, right, base) of every generator's spans in (rid, rth, text), equal rows once."""
    text = F.col("text")
    at, digit = F.contains(text, F.lit("@")), F.regexp_like(text, F.lit("[0-9]"))
    spelled = at | F.regexp_like(text, F.lit(r"[(\[]at[)\]]"))
    gates = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains(text, F.lit("+")), "address": spelled, "number": digit}
    rows = docs.select("rid", "rth", *[found(text, p, gates[k]).alias(k) for k, p in (BASE | WIDE).items()])
    rows = rows.filter(" or ".join(f"size({k}) > 0" for k in BASE | WIDE)).dropDuplicates(["rid", "rth"])
    each = rows.select("rid", "rth", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("spans")) for k in BASE | WIDE])).alias("k"))
    each = each.select("rid", "rth", "k.kind", F.posexplode("k.spans").alias("n", "s")).select("rid", "rth", "kind", "n", "s.*")
    upto = Window.partitionBy("rid", "rth", "kind").orderBy("n")
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto))
    each = each.withColumn("start", F.col("end") - F.length("value"))
    own = F.struct("kind", "start", "end", "value", "left", "right")
    each = each.select("rid", "rth", F.explode(F.concat(F.array(own), side_by_side())).alias("s")).select("rid", "rth", "s.*")
    return each.select("rid", "rth", "kind", "start", "end", "value", "left", "right", F.coalesce(valid(), F.lit(False)).alias("base"))


def side_by_side() -> Column:
    """The cards of a run with too many digits for one that falls apart into cards whole: each group one
    of them, or each four groups of four digits. They overlap the run, which is a candidate too."""
    g, value = F.split("value", "[ -]"), F.col("value")
    card = lambda x: F.length(x).between(13, 19) & luhn(x)
    single = F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.struct(F.aggregate(F.slice(g, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 1).alias("at"), g[i].alias("value")))
    fours = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(g) / 4).cast("int") - 1, F.lit(0))), lambda i: F.struct((i * 20).alias("at"), F.substring(value, i * 20 + 1, F.lit(19)).alias("value")))
    by_four = F.forall(g, lambda x: F.length(x) == 4) & (F.size(g) % 4 == 0) & F.forall(fours, lambda p: luhn(F.regexp_replace(p["value"], "[^0-9]", "")))
    found = F.when(F.forall(g, card), single).when(by_four, fours)
    placed = lambda p: F.struct(
        F.lit("cards").alias("kind"), (F.col("start") + p["at"]).alias("start"), (F.col("start") + p["at"] + F.length(p["value"])).alias("end"), p["value"].alias("value"),
        F.right(F.concat(F.col("left"), F.substring(value, F.lit(1), p["at"])), F.lit(LEFT)).alias("left"), F.left(F.concat(F.substring(value, p["at"] + F.length(p["value"]) + 1, F.lit(RIGHT)), F.col("right")), F.lit(RIGHT)).alias("right"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,left:string,right:string>>")
    return F.when((F.col("kind") == "card") & (F.length(digits_of()) > 19) & found.isNotNull(), F.transform(found, placed)).otherwise(none)


def plain(value: str = "value") -> Column:
    """A value with its spelling marks as the signs they stand for."""
    v = F.regexp_replace(value, r"\x20?(?:@|[(\[]at[)\]])\x20?", "@")
    return F.when(F.contains(v, F.lit("@")), F.regexp_replace(v, r"\x20?(?:\.|[(\[]dot[)\]])\x20?", ".")).otherwise(v)


def described(spans: DataFrame) -> DataFrame:
    """Format and context features, the same for a form of the base patterns and its other spellings:
    marks, separators, a plus sign, lengths of names and the characters around a value are left out."""
    flag = lambda c: c.cast("int").cast("double")
    v, groups = plain(), F.filter(F.split("value", "[^0-9]+"), lambda g: g != "")
    length = F.transform(groups, F.length)
    address = F.contains(v, F.lit("@"))
    size = lambda c: F.when(address, 0).otherwise(F.coalesce(c, F.lit(0))).cast("double")
    return spans.withColumns({
        "digits": size(F.length(digits_of())), "groups": size(F.size(groups)), "first_group": size(F.get(length, F.lit(0))), "last_group": size(F.get(length, F.size(length) - 1)), "longest_group": size(F.array_max(length)),
        "kinds_of_digits": size(F.size(F.array_distinct(F.split(digits_of(), "")))), "first_zero": size(F.startswith(digits_of(), F.lit("0")).cast("int")), "check_digit": size(card_like().cast("int")),
        "address": flag(address), "named": flag(F.regexp_like(v, F.lit("[A-Za-z][^@]*@"))), "domain": flag(F.regexp_like(v, F.lit(r"@[^.]+\."))), "top": flag(F.regexp_like(v, F.lit(r"\.[A-Za-z]{2,}$"))), "cue": flag(F.regexp_like("left", F.lit(CUE))),
    })


def card_like() -> Column:
    """The digits are those of a card; longer runs are not looked at."""
    digits = digits_of()
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def unrelated() -> Column:
    """Clearly no personal data: part of a longer name, of a kind named before it, a date, a number
    too long for a phone that is no card, a quadruple that is no address, an address without a domain."""
    left, right = F.col("left"), F.col("right")
    address = F.col("kind").isin("email", "address")
    inside = (F.regexp_like(left, F.lit(r"[\p{L}0-9_]$")) & ~F.regexp_like(left, F.lit(CUE + "$"))) | F.regexp_like(right, F.lit(r"^(?!(?i:x|ext)\.?[0-9])[\p{L}0-9_]"))
    named = F.regexp_like(left, F.lit(OTHER)) & ~F.regexp_like(left, F.lit(CUE))
    long = (F.length(digits_of()) > 15) & ~card_like()
    number = inside | named | long | F.startswith(right, F.lit("%")) | F.regexp_like("value", F.lit(DATE)) | F.regexp_like("value", F.lit(QUAD)) | (F.col("kind") == "ip")
    return F.when(address, ~F.regexp_like(plain(), F.lit(r"@[^.]+\."))).otherwise(number)


def labelled(spans: DataFrame) -> DataFrame:
    """Add ``label``: 1 on base spans, 0 where a candidate is clearly no personal data, null where
    nothing is known, which is no evidence against it. No generator looks for other forms of IP
    addresses, so they are no example."""
    ip = (F.col("kind") == "ip") | F.regexp_like("value", F.lit(QUAD))
    return spans.withColumn("label", F.when(F.col("covered"), F.when(~ip, 1.0)).when(unrelated(), 0.0))


def forms(rows: DataFrame) -> DataFrame:
    """Labelled candidates with further forms of those on base spans: without the country's digits, after
    a cue in one run, cards in groups of four (all 1); in one run with a wrong last digit and
    without a cue, or an address without its domain (all 0)."""
    form = lambda value, left=F.col("left"), label=1.0: F.struct(value.alias("value"), left.alias("left"), F.lit(label).alias("label"))
    number = ~F.col("kind").isin("email", "address")
    short = F.regexp_replace("value", r"^\+?[0-9]{1,3}[^0-9]+(?=[0-9])", "")
    run = digits_of()
    wrong = F.concat(F.expr("left(regexp_replace(value, '[^0-9]', ''), length(regexp_replace(value, '[^0-9]', '')) - 1)"), F.translate(F.right(run, F.lit(1)), "0123456789", "1234567890"))
    one, card, none = F.col("label") == 1, card_like(), F.lit("")
    more = F.array(
        F.struct("value", "left", "label"),
        F.when(one & number & ~card & (F.length(F.regexp_replace(short, "[^0-9]", "")) >= 7), form(short)),
        F.when(one & number & ~card & F.regexp_like("left", F.lit(CUE)), form(F.regexp_replace(short, "[^0-9]", ""))),
        F.when(one & card, form(F.regexp_replace(run, "([0-9]{4})(?=[0-9])", "$1-"))),
        F.when(one & number, form(wrong, none, 0.0)),
        F.when(one & ~number, form(F.regexp_replace(plain(), r"(@[^.]*)\..*$", "$1"), none, 0.0)),
    )
    return rows.select("rid", "rth", "kind", F.explode(F.array_compact(more)).alias("f")).select("rid", "rth", "kind", "f.*")


def overlapping(spans: DataFrame) -> DataFrame:
    """Add ``covered``: the span shares a character with a base span of its row."""
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    before = Window.partitionBy("rid", "rth").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("rid", "rth").orderBy("start", "end", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    hit = (F.max(base_end).over(before) > F.col("start")) | (F.min(base_start).over(after) < F.col("end"))
    return spans.withColumn("covered", F.coalesce(hit, F.lit(False)))


def fitted(spans: DataFrame, fit_rows: int = FIT_ROWS, precision: float = PRECISION) -> tuple[GBTClassificationModel, float] | None:
    """Trees for "personal data" from labelled candidates and their forms, and the least score above
    which ``precision`` of those of another half are so, both labels weighing the same; None
    where there is too little to learn from. Candidates without a label count for nothing."""
    half = F.pmod(F.xxhash64("rid", "rth", F.lit("half")), F.lit(2))
    sizes = {(r["half"], r["label"]): r["count"] for r in spans.groupBy(half.alias("half"), "label").count().collect()}
    if min(sizes.get((h, 1.0), 0) for h in (0, 1)) < LEAST_ROWS // 10 or sum(sizes.values()) < LEAST_ROWS:
        return None
    share = min(1.0, fit_rows / (sizes[0, 1.0] + sizes.get((0, 0.0), 0)))
    draw = F.pmod(F.xxhash64("rid", "rth", "start", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    ready = lambda rows: VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(forms(rows)))
    known = spans.filter("label IS NOT NULL")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=SEED, checkpointInterval=-1)
    model = trees.fit(written(ready(known.filter((half == 0) & (draw < share))).select("features", "label"), "fit"))
    scored = model.transform(ready(known.filter(half == 1))).select(F.floor(vector_to_array("probability")[1] * STEPS).cast("int").alias("bin"), "label")
    bins = scored.groupBy("bin").agg(F.sum("label").alias("hits"), F.sum(1 - F.col("label")).alias("misses")).orderBy(F.desc("bin")).collect()  # STEPS + 1 rows at most
    hits, misses = sum(b["hits"] for b in bins), max(sum(b["misses"] for b in bins), 1)
    least, h, m = None, 0.0, 0.0
    for b in bins:  # from the top: just above the first score that costs the precision, and never below one half
        h, m = h + b["hits"] / hits, m + b["misses"] / misses
        if h < precision * (h + m):
            return (model, max(0.5, (b["bin"] + 1) / STEPS)) if least is not None else None
        least = b["bin"] / STEPS
    return model, max(0.5, least)


def spans_of(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text) to (rid, rth, doc_id) of every row, and (rid, rth, kind, start, end, base) of every chosen span."""
    keyed = docs.select(*row_key(), "doc_id", "text")
    names = keyed.select("rid", "rth", "doc_id")
    spans = written(labelled(overlapping(candidates(keyed))), "spans")
    chosen = spans.filter("base")
    if learned := fitted(spans, **options):
        model, least = learned
        rest = described(spans.filter("NOT base AND NOT covered AND label IS NULL"))
        rest = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rest)).filter(vector_to_array("probability")[1] >= least)
        kind = F.when(F.col("kind").isin("email", "address"), "email").when(F.col("check_digit") == 1, "card").otherwise("phone")
        rest = rest.withColumn("kind", kind).dropDuplicates(["rid", "rth", "kind", "start", "end"])
        chosen = chosen.unionByName(rest.select(chosen.columns))
    return names, chosen.select("rid", "rth", "kind", "start", "end", "base")


def listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added).

    The base spans are those of the fixed patterns and checks; generators with a higher recall
    propose further, overlapping ones. Boosted trees on format and context learn to tell candidates
    on base spans, and their spellings without the base marks, from those that are clearly no
    personal data, on a bounded sample of one half of the documents; the other half sets the
    threshold with the wanted precision. All other candidates outside base spans, however many,
    have no label; those that reach the threshold are added. Offsets count code points, the end is
    exclusive.

    A null or empty text has no spans; rows with equal id and text have the same; where candidates
    are too few to learn from, only base spans are returned; an empty table gives no rows; other
    columns are not looked at. Texts are read once and never shuffled.
    """
    names, spans = spans_of(texts(docs, id_col, text_col), **options)
    no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("no")
    per = spans.groupBy("rid", "rth").agg(F.sort_array(F.collect_list(F.struct(no, "start", "end", "base"))).alias("s"))
    out = names.join(per, ["rid", "rth"], "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<no:int,start:bigint,end:bigint,base:boolean>>")))
    base = F.filter("s", lambda s: s["base"])
    base_no = F.transform(base, lambda s: s["no"])
    counts = [(F.size(base_no) - F.size(F.array_remove(base_no, n))).cast("bigint").alias(f"n_{k}") for n, k in enumerate(KINDS, 1)]
    return out.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"), F.size(F.filter("s", lambda s: ~s["base"])).cast("bigint").alias("n_added"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by its kind in angle brackets; all other columns stay.

    Overlapping spans are replaced as one, under the kind of the first. Null texts stay null.
    """
    key = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("rid"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("rth")]
    _, spans = spans_of(texts(docs, id_col, text_col), **options)
    reach = Window.partitionBy("rid", "rth").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("new", (F.coalesce(F.max("end").over(reach), F.lit(-1)) <= F.col("start")).cast("int"))
    upto = Window.partitionBy("rid", "rth").orderBy("start", F.desc("end"), "kind")
    merged = spans.withColumn("run", F.sum("new").over(upto)).groupBy("rid", "rth", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("k"))
    per = merged.groupBy("rid", "rth").agg(F.sort_array(F.collect_list(F.struct("a", "b", "k"))).alias("s"))
    rows = docs.select(*key, F.struct("*").alias("doc")).join(per, ["rid", "rth"], "left")
    t, s = F.col(f"doc.{text_col}"), F.col("s")
    piece = lambda i: F.concat(F.substring(t, F.when(i > 0, s[F.greatest(i - 1, F.lit(0))]["b"]).otherwise(0).cast("int") + 1, (s[i]["a"] - F.when(i > 0, s[F.greatest(i - 1, F.lit(0))]["b"]).otherwise(0)).cast("int")), F.lit("<"), F.upper(s[i]["k"]), F.lit(">"))
    text = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(s) - 1), piece), ""), F.substring(t, F.element_at(s, -1)["b"].cast("int") + 1, F.length(t)))
    return rows.select("doc.*", F.when(s.isNotNull(), text).otherwise(t).alias("__text")).withColumn(text_col, F.col("__text")).drop("__text")
