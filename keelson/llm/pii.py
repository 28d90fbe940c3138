"""Personal data by fixed patterns and by bootstrapped contexts (DataFrame functions only).

Base spans come from four patterns, leftmost and non-overlapping per kind; a match that fails its test is dropped
without a retry.  They are written here with possessive loops and run starts, which find the same matches in
linear time however long a text's runs of letters or digits are.

Contexts: a candidate is a word with a digit or ``@``.  Base spans seed the identifiers.  The one and
the two words before a candidate (candidates too, lower-cased) are its lexical patterns; pattern and candidate form a graph that Spark scores for
``ROUNDS`` rounds: a pattern's confidence is the share of all words at its place in the corpus that are trusted
identifiers, and an identifier's is the chance that one of its patterns is right.  Patterns need ``MIN_SUPPORT`` different
trusted identifiers and ``MIN_CONFIDENCE``; candidates of at least that confidence that no base span touches are added
as kind ``id``.  Nothing is capped: every pattern's count covers all documents.

Defined cases: a null text counts as empty; offsets are code points; rows that repeat a doc_id keep
their own spans; null doc_ids are kept; words of any length are compared whole; an empty table gives no rows; :func:`redact`
keeps every input column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import materialize, table, text_key

KINDS = ("email", "ip", "card", "phone", "id")
WS = r"\x20\x09-\x0D"
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: texts without a match of these have no base span of the kind
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CANDIDATE = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+"
EDGES = "\"'`.,;:!?()[]{}<>"
SPAN = "array<struct<start:int,kind:int,end:int>>"

MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.5
ROUNDS = 3
#: stands for the words before a text's first word; no word is like it
START = " "
#: patterns that may be broadcast (about 16 bytes each); more are joined by a shuffle
BROADCAST_PATTERNS = 500_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _located(text: Column, pattern: str, keep, made, out: str) -> Column:
    """made(start, match, tail) of every match of ``pattern`` that ``keep`` accepts, as an array of type ``out``.

    Positions come from the pieces between the matches; ``tail`` holds the last words before the match, two at most.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def step(acc, x):
        def add(tail):
            start = acc["pos"] + F.length(x["p"])
            more = F.when(keep(x["m"]), F.concat(acc["out"], F.array(made(start, x["m"], tail)))).otherwise(acc["out"])
            return F.struct((start + F.length(x["m"])).alias("pos"), more.alias("out"), _last_two(F.concat(tail, F.array(x["m"]))).alias("tail"))
        tail = _last_two(F.concat(acc["tail"], _words(x["p"])))
        return F.when(x["m"].isNull(), acc).otherwise(F.get(F.transform(F.array(tail), add), F.lit(0)))
    empty = F.lit(None).cast(f"struct<pos:int,out:{out},tail:array<string>>")
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(out).alias("out"), F.array().cast("array<string>").alias("tail"))
    return F.aggregate(pairs, F.coalesce(zero, empty), step, lambda acc: acc["out"])


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def _last_two(words: Column) -> Column:
    return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))


CANDIDATES = "array<struct<start:int,end:int,word:string,w1:string,w2:string>>"


def kind_spans(text: Column, kind: str) -> Column:
    """The base spans of one kind as array<struct<start, kind, end>>; the text must not be null."""
    at = F.lit(KINDS.index(kind))
    found = _located(text, PATTERNS[kind], lambda m: _holds(kind, m),
                     lambda start, m, _: F.struct(start.alias("start"), at.alias("kind"), (start + F.length(m)).alias("end")), SPAN)
    return F.when(text.rlike(GATES[kind]), found).otherwise(F.array().cast(SPAN))


def _candidates(text: Column) -> Column:
    """Words with a digit or @, without edge punctuation, and the two words before each (lower-cased; START where there is none)."""
    def made(start, m, tail):
        core, lead = F.btrim(m, F.lit(EDGES)), F.length(m) - F.length(F.ltrim(m, F.lit(EDGES)))
        return F.struct((start + lead).alias("start"), (start + lead + F.length(core)).alias("end"), core.alias("word"),
                        F.lower(F.coalesce(F.get(F.reverse(tail), F.lit(0)), F.lit(START))).alias("w1"),
                        F.lower(F.coalesce(F.get(F.reverse(tail), F.lit(1)), F.lit(START))).alias("w2"))
    found = _located(text, CANDIDATE, lambda m: F.btrim(m, F.lit(EDGES)) != "", made, CANDIDATES)
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(CANDIDATES))


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, th (a digest of the text), the base spans of each kind and the candidates: one scan, no text kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    return rows.select("doc_id", text_key().alias("th"), *[kind_spans(F.col("text"), k).alias(k) for k in KINDS[:4]],
                       _candidates(F.col("text")).alias("candidates"))


def _patterns(w1: Column, w2: Column) -> Column:
    """The lexical patterns of a place, as hashes: the word before it, and the two words before it."""
    return F.when(w1 != START, F.array(F.xxhash64(w1), F.xxhash64(w2, w1))).otherwise(F.array().cast("array<bigint>"))


def _place_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How many words of the whole corpus stand at each pattern's place."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), f"[{WS}]+"), lambda w: w != "")
    rows = docs.select(F.concat(F.array(F.lit(START), F.lit(START)), words).alias("w")).where(F.size("w") > 3)
    hashes = F.transform(F.sequence(F.lit(2), F.size("w") - 2), lambda i: _patterns(F.get("w", i), F.get("w", i - 1)))
    places = rows.select(F.explode(F.flatten(hashes)).alias("pattern"))
    small = patterns.count() <= BROADCAST_PATTERNS
    known = patterns.select(F.col("pattern").alias("known"))
    if not small:  # combined before the shuffle
        places = places.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        return places.join(known, F.col("pattern") == F.col("known")).select("pattern", F.col("n").alias("places"))
    return places.join(F.broadcast(known), F.col("pattern") == F.col("known")).groupBy("pattern").agg(F.count(F.lit(1)).alias("places"))


def discover(docs: DataFrame, base: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
             min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, th and ``found`` (array of spans of kind id) for the rows with contextual identifiers."""
    touched = F.exists(F.concat(*KINDS[:4]), lambda s: (s["start"] < F.col("c.end")) & (s["end"] > F.col("c.start")))
    cand = base.select("doc_id", "th", *KINDS[:4], F.explode("candidates").alias("c")).select(
        "doc_id", "th", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.word").alias("word"),
        _patterns(F.col("c.w1"), F.col("c.w2")).alias("patterns"), touched.alias("seed"))
    cand = materialize(cand, "pii-candidates")
    edges = cand.select("word", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "word").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("seed").alias("seeds"))
    edges = materialize(edges, "pii-edges")
    patterns = materialize(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") >= min_support), "pii-patterns")
    places = materialize(_place_counts(docs, patterns), "pii-places")
    graph = edges.join(places, "pattern")
    graph = materialize(graph, "pii-graph")
    trusted = None
    for _ in range(rounds):
        weight = F.col("seeds").cast("double")
        scored = graph
        if trusted is not None:  # occurrences that are no seed count by their word's confidence
            scored = graph.join(trusted.withColumnRenamed("word", "known"), F.col("word") == F.col("known"), "left")
            weight = weight + (F.col("n") - F.col("seeds")) * F.coalesce("confidence", F.lit(0.0))
        rated = (scored.withColumn("_w", weight).groupBy("pattern")
                 .agg(F.sum("_w").alias("_sum"), F.count_if(F.col("_w") > 0).alias("support"), F.first("places").alias("places")))
        # trusted identifiers are some of the words at the place: more of them would mean that the two were read differently
        rate = F.when(F.col("_sum") <= F.col("places") * (1 + 1e-9), F.col("_sum") / F.col("places")).otherwise(
            F.raise_error(F.lit("more identifiers than places of a pattern")).cast("double"))
        rated = rated.select(F.col("pattern").alias("p"), "support", rate.alias("rate"))
        rated = materialize(rated.where((F.col("support") >= min_support) & (F.col("rate") >= min_confidence)), "pii-rated")
        doubt = F.sum(F.log1p(-F.least(F.col("rate"), F.lit(1 - 1e-9))))
        trusted = materialize(graph.where("n > seeds").join(rated, F.col("pattern") == F.col("p")).groupBy("word").agg((1 - F.exp(doubt)).alias("confidence"))
                              .where(F.col("confidence") >= min_confidence), "pii-trusted")
    if trusted is None:
        return cand.select("doc_id", "th", F.array().cast(SPAN).alias("found")).limit(0)
    # the words are trusted at the places of trusted patterns
    here = (cand.where(~F.col("seed")).select("doc_id", "th", "start", "end", "word", F.explode("patterns").alias("pattern"))
            .join(rated.select("p"), F.col("pattern") == F.col("p"))
            .join(trusted.select(F.col("word").alias("known")), F.col("word") == F.col("known")))
    spans = here.select("doc_id", "th", F.struct(F.col("start"), F.lit(KINDS.index("id")).alias("kind"), F.col("end")).alias("s"))
    # the spans of one text, bounded by it
    return materialize(spans.groupBy("doc_id", "th").agg(F.collect_set("s").alias("found")), "pii-found")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_found(rows: DataFrame, found: DataFrame, key: Column) -> DataFrame:
    found = found.select(F.col("doc_id").alias("_pii_id"), F.col("th").alias("_pii_th"), F.col("found").alias("_pii_found"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_pii_id")) & (key == F.col("_pii_th")), "left")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind and of ids, the digest of the base spans, and all spans."""
    base = materialize(base_table(docs), "pii-base")
    rows = _with_found(base, discover(docs, base), F.col("th"))
    basic = F.concat(*KINDS[:4])
    every = F.concat(basic, F.coalesce("_pii_found", F.array().cast(SPAN)))
    return rows.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]],
                       F.sha2(_joined(basic).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
                       F.size(F.coalesce("_pii_found", F.array().cast(SPAN))).cast("bigint").alias("n_id"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, every span replaced by its kind in brackets; overlapping spans count as the first of them."""
    base = materialize(base_table(docs), "pii-base")
    found = discover(docs, base)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = F.array_sort(F.concat(*[kind_spans(text, k) for k in KINDS[:4]], F.coalesce("_pii_found", F.array().cast(SPAN))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc, s):
        cut = F.concat(acc["out"], F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.get(names, s["kind"]))
        return F.when(s["start"] >= acc["pos"], F.struct(s["end"].alias("pos"), cut.alias("out"))).otherwise(
            F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    clean = F.aggregate("_pii_spans", zero, step, lambda a: F.concat(a["out"], F.substr(text, a["pos"] + 1, F.length(text))))
    rows = _with_found(docs, found, text_key()).withColumn("_pii_spans", spans)
    return rows.withColumn("text", F.when(F.size("_pii_spans") > 0, clean).otherwise(F.col("text"))).select(*docs.columns)


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
