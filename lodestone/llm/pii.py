r"""Personal data by regular expressions and bootstrapped contextual extraction, in DataFrame functions only.

Base spans (kinds ``KINDS``) come from fixed expressions and are the seed entities, blanks inside included. Values behind a
key word such as ``token =`` are seeds of one more kind, ``secret``, which only the method adds. Beside the seeds stand the
instances that may be found: identifier-shaped words (with a digit or ``@``) and runs of such words that touch no seed. What
looks like a card or an address but fails its check is a near miss: it counts against patterns and is never found.

Patterns are lexical: the word before an instance, the two before, the word behind, either side together, and the word or
the marks (such as ``="``) before it with each other or with the instance's shape. A pattern-instance graph is scored for
``ROUNDS`` rounds. With s the summed score of a pattern's instances for a kind, its confidence is s over s plus the
instances known to be something else, plus ``UNKNOWN`` for each other one, plus ``SMOOTHING``. Seeds of the kind, wherever
else they stand, score 1; other instances the noisy-or of the sure patterns that point to them. A pattern is sure from
``MIN_SUPPORT`` in s and ``MIN_CONFIDENCE`` on; after the last round the sure ones mark the instances that they point to,
and a known seed is marked wherever it stands.

The expressions below are written so that each starts only at the head of a run (or where the last match ended) and never
backs off; they match what the plain ones match, in time linear in the text. Texts without a digit or ``@`` are passed over.

Defined results: a null text counts as empty (no spans; the hash of the empty string); repeated rows get equal spans; a
null doc_id is carried; an empty table gives an empty result; other columns are not read (or pass through ``redact``,
whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, bounded, hot_keys, join_hot, text_hash, whole

KINDS = ("email", "ip", "card", "phone")
#: All kinds; those behind the base ones are found by the method alone.
NAMES = (*KINDS, "secret")
SECRET, MISS = len(KINDS), -1
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: A value of sixteen characters or more with a digit, behind a key word and a sign. The key words.
SECRET_VALUE = r"(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+"
SECRET_SEED = r"(?i)(?<![A-Za-z0-9_])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?+\x20?+[=:]\x20?+[\"']?+" + SECRET_VALUE
#: A word with a digit or an @; words end at ASCII white space.
IDENTIFIER = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"
#: Two or more such words with blanks between, none but the last ending in a mark of punctuation.
RUN = IDENTIFIER + r"(?:(?<![.,;:!?])\x20++(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++)++"
ROUNDS, SMOOTHING, UNKNOWN, MIN_SUPPORT, MIN_CONFIDENCE = 3, 0.5, 0.5, 4, 0.75
#: Matches of a text that are placed together.
BLOCK = 256

_SPAN = "struct<start:int,kind:int,end:int>"
_FOUND = "array<struct<start:int,end:int,kind:int,value:string,before:string,marks:string,last:string,next:string>>"


def _bound(value: Column, use) -> Column:
    """use(value) with ``value`` worked out once, which Spark does not do by itself inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _located(text: Column, pattern: str, make, kind: str) -> Column:
    """Matches of ``pattern`` with their places: between matches lie the pieces that ``split`` returns.

    make(start, match, piece before, piece after) gives the array element.
    """
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(make(start, x["m"], x["before"], x["after"])).cast(kind)).alias("out"))

    def block_step(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _bound(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    def place(rows: Column) -> Column:
        # in blocks, since an array that grows by one match at a time is copied each time
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), block_step, lambda acc: F.flatten(acc["out"]))

    def beside(found: Column) -> Column:
        rows = F.arrays_zip(found["m"], found["p"].alias("before"), F.slice(found["p"], 2, F.size(found["p"])).alias("after"))
        return F.when(F.size(found["m"]) > 0, _bound(F.slice(rows, 1, F.size(found["m"])), place)).otherwise(none)

    return _bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), beside)


def _valid_ip(m: Column) -> Column:
    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return (F.length(digits) <= 3) & (F.substring(digits, 1, 3).cast("int") <= 255)

    return F.forall(F.split(m, r"\."), part)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid_card(m: Column) -> Column:
    d = _digits(m)

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    luhn = F.aggregate(F.sequence(F.lit(1), F.least(F.length(d), F.lit(19))), F.lit(0), step) % 10 == 0
    return F.when(F.length(d).between(14, 19), luhn).otherwise(False)


def _valid_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _of_kind(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda b: b["kind"] == kind)


def _kind(kind: int, value: Column) -> Column:
    """``kind`` for a valid match of its expression, ``MISS`` for one that only its check refuses, else null."""
    if KINDS[kind] == "ip":
        return F.when(_valid_ip(value), kind).otherwise(MISS)
    if KINDS[kind] == "card":
        return F.when(_valid_card(value), kind).when(F.length(_digits(value)).between(14, 19), MISS)
    if KINDS[kind] == "phone":
        return F.when(_valid_phone(value), kind)
    return F.lit(kind)


_WORD, _MARK = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def _instance(start: Column, value: Column, kind: Column, before: Column, after: Column) -> Column:
    """The element of ``_FOUND``: the words before and behind, lower-cased, and the marks between the last word and the value."""
    last = rf"(?<!{_WORD})({_WORD}++)({_MARK}*+)$"
    return F.struct(
        start.alias("start"), (start + F.length(value)).alias("end"), kind.alias("kind"), value.alias("value"),
        F.lower(F.regexp_extract(before, rf"(?<!{_WORD})({_WORD}++){_MARK}++{_WORD}++{_MARK}*+$", 1)).alias("before"),
        F.regexp_replace(F.regexp_extract(before, last, 2), r"\s+", "").alias("marks"),
        F.lower(F.regexp_extract(before, last, 1)).alias("last"), F.lower(F.regexp_extract(after, rf"^{_MARK}*+({_WORD}++)", 1)).alias("next"),
    )


def _if(text: Column, sign: str, found: Column) -> Column:
    return F.when(F.rlike(text, F.lit(sign)), found).otherwise(F.array().cast(_FOUND))


#: Without a match of this there is nothing to find.
_SIGNS = ("@", "[0-9]", "[0-9]", r"\+[0-9]")


def seeds(text: Column) -> Column:
    """Base spans, near misses and secrets with their neighbouring words."""
    found = []
    for kind, (pattern, sign) in enumerate(zip(PATTERNS, _SIGNS, strict=True)):
        one = _located(text, pattern, lambda s, m, a, b, k=kind: _instance(s, m, _kind(k, m), a, b), _FOUND)
        found.append(_if(text, sign, F.filter(one, lambda x: x["kind"].isNotNull())))

    def secret(s: Column, m: Column, a: Column, b: Column) -> Column:
        value = F.regexp_extract(m, SECRET_VALUE + "$", 0)
        lead = F.length(m) - F.length(value)
        return _instance(s + lead, value, F.lit(SECRET), F.concat(a, F.left(m, lead)), b)

    found.append(_if(text, "[0-9]", _located(text, SECRET_SEED, secret, _FOUND)))
    return F.concat(*found)


def identifiers(text: Column) -> Column:
    """Identifier-shaped words and runs of them without the punctuation around them, with their neighbouring words."""
    def make(start: Column, m: Column, before: Column, after: Column) -> Column:
        lead = F.length(F.regexp_extract(m, r"^[^A-Za-z0-9+]*+", 0))
        core = F.regexp_replace(F.substring(m, lead + 1, F.length(m)), r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
        return _instance(start + lead, core, F.lit(None).cast("int"), F.concat(before, F.left(m, lead)), F.concat(F.substring(m, lead + 1 + F.length(core), F.length(m)), after))

    both = F.concat(_located(text, IDENTIFIER, make, _FOUND), _located(text, RUN, make, _FOUND))
    return _if(text, "[0-9@]", F.filter(both, lambda x: F.length(x["value"]) >= 4))


def base_spans(found: Column) -> Column:
    """Base spans as array<struct<start, kind, end>>, by start, then kind; places are code points from 0."""
    base = F.filter(found, lambda x: x["kind"].between(0, SECRET - 1))
    return F.array_sort(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))


def shape(value: Column) -> Column:
    """Digits as 9, letters as a, mixtures of both as x, other characters as they are; and the octave of the length."""
    runs = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), r"\p{N}+", "9")
    return F.concat_ws("|", F.regexp_replace(runs, "(?:9a|a9)[9a]*+", "x"), F.floor(F.log2(F.length(value))).cast("string"))


def patterns() -> Column:
    """The lexical patterns of an instance (columns value, before, marks, last, next)."""
    def of(mark: str, *parts: Column) -> Column:
        there = F.length(parts[0]) > 0
        for p in parts[1:]:
            there = there & (F.length(p) > 0)
        return F.when(there, F.concat_ws(" ", F.lit(mark), *parts))

    before, marks, last, next_, form = F.col("before"), F.col("marks"), F.col("last"), F.col("next"), shape(F.col("value"))
    return F.array_compact(F.array(of("L", last), of("LL", before, last), of("R", next_), of("LR", last, next_), of("LM", last, marks), of("LS", last, form), of("MS", marks, form)))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def score_patterns(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Sure patterns (pattern, kind, confidence) of the written graph ``edges`` (pattern, instance, seed, miss): distinct pairs; seed and miss are the instance's."""
    sizes = scratch.save(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("seed").alias("seeds"), F.count_if("miss").alias("misses")), "sizes")
    by_instance, by_pattern = hot_keys(edges, "instance"), hot_keys(edges, "pattern")
    told = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("own"))
    open_ = edges.where("seed is null and not miss").select("pattern", "instance")
    sure, found = None, None
    for i in range(ROUNDS):
        support = told.select("pattern", "kind", "own", F.lit(0.0).alias("s"), F.lit(0).alias("more"))
        if found is not None:
            gained = join_hot(open_, found, "instance", by_instance).select("pattern", "kind", F.lit(0).alias("own"), F.col("score").alias("s"), F.lit(1).alias("more"))
            support = support.unionByName(gained)
        support = support.groupBy("pattern", "kind").agg(F.sum("own").alias("own"), F.sum("s").alias("s"), F.sum("more").alias("more"))
        s = F.col("own") + F.col("s")
        against = F.col("seeds") - F.col("own") + F.col("misses")
        unknown = F.col("n") - F.col("seeds") - F.col("misses") - F.col("more")
        rated = support.where(s >= MIN_SUPPORT).join(sizes, "pattern").select("pattern", "kind", (s / (s + against + UNKNOWN * unknown + SMOOTHING)).alias("confidence"))
        sure = scratch.save(rated.where(F.col("confidence") >= MIN_CONFIDENCE), f"sure{i}")
        doubt = F.sum(F.log1p(-F.least("confidence", F.lit(0.999999))))
        found = scratch.save(join_hot(open_, sure, "pattern", by_pattern).groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score")), f"found{i}")
    return sure


def _free(rows: DataFrame) -> DataFrame:
    """(doc_id, h, x, kind): all seeds and near misses that touch no base span but may be one, and the identifiers that touch nothing."""
    spans = rows.where(F.size("found") + F.size("ids") > 0).select("doc_id", "h", F.explode(F.concat("found", "ids")).alias("x")).withColumn("kind", F.col("x.kind"))
    same = Window.partitionBy("doc_id", "h")
    # both frames grow from their partition's head: one that shrinks to its end would be worked out anew for each row
    before, behind = (same.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("x.start"), F.desc("x.start")))
    base, other = F.col("kind").between(0, SECRET - 1), F.col("kind").isNotNull()

    def touched(by: Column) -> Column:
        reach, ahead = F.max(F.when(by, F.col("x.end"))).over(before), F.min(F.when(by, F.col("x.start"))).over(behind)
        return F.coalesce(reach > F.col("x.start"), F.lit(False)) | F.coalesce(ahead < F.col("x.end"), F.lit(False))

    marked = spans.withColumn("on_base", touched(base)).withColumn("on_any", touched(other))
    return marked.where(base | (other & ~F.col("on_base")) | ~F.col("on_any")).drop("on_base", "on_any")


def analyse(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, more): the spans that the method adds to the written ``rows`` (doc_id, h, found, ids), as a written table."""
    told = scratch.save(_free(rows).select("doc_id", "h", "x.*").select("doc_id", "h", "start", "end", "kind", F.col("value").alias("instance"), F.explode_outer(patterns()).alias("pattern")), "met")
    nodes = told.groupBy("instance").agg(F.min(F.when(F.col("kind") >= 0, F.col("kind"))).alias("seed"), F.coalesce(F.bool_or(F.col("kind") == MISS), F.lit(False)).alias("miss"))
    nodes = scratch.save(nodes, "nodes")
    pairs = scratch.save(told.where("pattern is not null").select("pattern", "instance").distinct(), "pairs")
    edges = scratch.save(join_hot(pairs, nodes, "instance", hot_keys(pairs, "instance")), "edges")
    sure = score_patterns(edges, scratch)
    key = ["doc_id", "h", "start", "end"]
    free = told.where("kind is null")
    by_pattern = join_hot(free, sure.select("pattern", F.col("kind").alias("as"), "confidence"), "pattern", hot_keys(told, "pattern"))
    known = join_hot(free.select(*key, "instance").distinct(), nodes.where("seed is not null").select("instance", F.col("seed").alias("as"), F.lit(1.0).alias("confidence")), "instance", hot_keys(free, "instance"))
    secrets = told.where(F.col("kind") >= SECRET).select(*key, F.col("kind").alias("as"), F.lit(1.0).alias("confidence"))
    best = by_pattern.select(*key, "as", "confidence").unionByName(known.select(*key, "as", "confidence")).unionByName(secrets)
    best = best.groupBy(*key).agg(F.min(F.struct(-F.col("confidence"), F.col("as")))["as"].alias("kind"))
    # of a run and a word in it that are both marked the run stays
    before = Window.partitionBy("doc_id", "h").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("over", F.max("end").over(before)).where("over is null or end > over")
    done = scratch.save(best.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "kind", "end")).cast(f"array<{_SPAN}>").alias("more")), "extra")
    scratch.keep("rows", "extra")
    return done


def _scanned(docs: DataFrame, scratch: Scratch, *columns: Column) -> DataFrame:
    """``columns`` of ``docs`` with doc_id, h, found and ids, as a written table."""
    return scratch.save(docs.select(*columns, F.col("doc_id"), text_hash().alias("h"), seeds(whole()).alias("found"), identifiers(whole()).alias("ids")), "rows")


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """``rows`` with base and all, their base spans and all spans."""
    more = bounded(extra.select(F.col("doc_id").alias("i"), F.col("h").alias("k"), "more"))
    met = rows.join(more, rows.doc_id.eqNullSafe(F.col("i")) & (rows.h == F.col("k")), "left").withColumn("base", base_spans(F.col("found")))
    return met.withColumn("all", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>")))))


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added."""
    scratch = Scratch(spark, "pii")
    rows = _scanned(docs, scratch)
    counts = [F.size(_of_kind("base", k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    size = F.size("all").cast("long")
    return _with_extra(rows.drop("ids"), analyse(rows, scratch)).select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), size.alias("n_spans"), (size - F.size("base")).alias("n_added"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with a mark such as [EMAIL] in the place of each span; what overlaps an earlier span goes with it."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in NAMES])

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with every span, base or added, masked in ``text``; all other columns as they were. Texts are scanned once: a written copy holds them beside their spans."""
    scratch = Scratch(spark, "pii-redact")
    rows = _scanned(docs, scratch, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    full = _with_extra(rows.drop("ids"), analyse(rows, scratch))
    masked = F.when(F.size("all") > 0, redacted(F.col("doc.text"), F.col("all"))).otherwise(F.col("doc.text"))
    return full.select(F.col("doc").withField("text", masked).alias("doc")).select("doc.*")
