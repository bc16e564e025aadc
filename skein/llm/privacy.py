"""Personal data: patterned base spans, and terms that give protected entities away.

Everything is DataFrame expressions. A protected entity is a value that a base pattern finds (an e-mail
address, IP address, card or phone number, normalised). Its contexts are the lines it stands in. From the
whole corpus come the number of lines N, the lines n(e) of each entity, n(t) of each term and n(e, t) of both;
the disclosure of e by t is the share of the entity's information that the term carries:

    D(e; t) = PMI(e; t) / IC(e) = (log N + log n(e, t) - log n(t) - log n(e)) / (log N - log n(e))

A term at ``GENERALISE_AT`` or more is generalised in that entity's lines, at ``REMOVE_AT`` or more it is removed.
It must be seen with the entity in ``SUPPORT`` different line texts, so copies of one line prove nothing.

The general term comes from the corpus, too, by the rule of subsumption: a term that stands in at least ``SUBSUMES``
of the entity's lines is broader than what stands in some of them. Of those whose own disclosure is below
``GENERALISE_AT`` the most telling one is taken (ties: the first by name); without any, the entity's kind.

Defined results: null and empty texts have no spans; rows with null or repeated ids are separate rows; an
empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_rows

GENERALISE_AT, REMOVE_AT, SUPPORT, SUBSUMES = 0.90, 0.98, 3, 0.8
#: Candidate terms up to which they are sent to all tasks (checked by a count); more are joined after aggregation.
BROADCAST_TERMS = 50_000

# Possessive forms of the patterns match the same spans as the plain ones, without recursion or retries over long
# runs; (?<!..)|\G keeps a search from starting within a run that has been tried already.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_NO_WORD = r"[^\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{N}]+"
_SPANS = "array<struct<s:int,e:int,m:string>>"


def located(text: Column, pattern: str) -> Column:
    """All matches with their places, from the pieces between them."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc, x):
        start = acc["p"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("p"), F.concat(acc["l"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("l"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("p"), F.array().cast(_SPANS).alias("l")), step, lambda acc: acc["l"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def value(i):
        v = F.substring(d, i, F.lit(1)).cast("int")
        twice = v * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i))
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


_PASSES = {
    "email": None,
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    found = located(text, PATTERNS[kind])
    test = _PASSES[kind]
    if test is not None:
        found = F.filter(found, lambda x: test(x["m"]))
    may = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
    return F.when(may & (text.rlike("[0-9]") if kind != "email" else F.lit(True)), found).otherwise(F.array().cast(_SPANS))


def _entity(kind: str, m: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(m) if kind == "email" else m if kind == "ip" else _digits(m))


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_col: str | None = None) -> DataFrame:
    """``id, seq, spans``: each base span with kind, place, entity, and its line with the line's start.

    ``seq_col``: distinct longs that tell the rows apart; without it they are numbered.
    """
    seq = F.col(seq_col) if seq_col else F.monotonically_increasing_id()
    rows = text_rows(docs, id_col, text_col, seq.alias("_seq")).withColumnRenamed("_seq", "seq")
    rows = rows.select("id", "seq", "text", *(base_spans(F.col("text"), k).alias(k) for k in KINDS))

    def full(kind):
        def one(x):
            left = F.substring(F.col("text"), F.lit(1), x["s"])
            start = x["s"] - F.length(F.substring_index(left, "\n", -1))
            line = F.substring_index(F.substring(F.col("text"), start + 1, F.length("text")), "\n", 1)
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _entity(kind, x["m"]).alias("entity"), start.alias("line_start"), line.alias("line"))

        return F.transform(F.col(kind), one)

    return rows.select("id", "seq", F.concat(*(full(k) for k in KINDS)).alias("spans"))


def disclosing_terms(docs: DataFrame, base: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, at: float = GENERALISE_AT) -> DataFrame:
    """``entity, term, disclosure, general`` of all pairs at or above the threshold; counts cover every line of every text."""
    text = text_rows(docs, id_col, text_col)
    bare = F.col("line")
    for k in KINDS:
        bare = F.regexp_replace(bare, PATTERNS[k], " ")
    contexts = base.select("seq", F.explode("spans").alias("x")).select("seq", "x.entity", "x.line_start", "x.line").distinct()
    # A word that an entity's own line has: counted first per line text, so a line with many copies weighs little.
    per_line = contexts.groupBy("entity", "line").agg(F.count("*").alias("c"))
    words = F.array_distinct(F.transform(F.split(bare, _NO_WORD), lambda t: F.lower(t)))
    pairs = per_line.select("entity", "c", F.explode(words).alias("term")).where("term != '' and term rlike '\\\\p{L}'")
    both = pairs.groupBy("entity", "term").agg(F.sum("c").alias("n_et"), F.count("*").alias("lines")).where(F.col("lines") >= support)
    both = staged(both, "privacy-pairs")
    n_entity = per_line.groupBy("entity").agg(F.sum("c").alias("n_e"))
    terms = staged(both.select("term").distinct(), "privacy-terms")
    each = text.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(F.array_distinct(F.transform(F.split("line", _NO_WORD), lambda t: F.lower(t)))).alias("term"))
    small = terms.count() <= BROADCAST_TERMS
    if small:
        n_term = each.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        n_term = each.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    total = text.agg(F.sum(newlines + 1).cast("double")).first()[0] or 0.0
    scored = both.join(n_term, "term").join(n_entity, "entity")
    log = lambda c: F.log(F.col(c).cast("double"))
    n = F.log(F.greatest(F.lit(total), F.lit(1.0)))
    worth = n - log("n_e")
    d = F.when(worth > 0, (n + log("n_et") - log("n_t") - log("n_e")) / worth).otherwise(0.0)
    scored = staged(scored.select("entity", "term", d.alias("disclosure"), (F.col("n_et") >= SUBSUMES * F.col("n_e")).alias("broad")), "privacy-scored")
    broad = scored.where(F.col("broad") & (F.col("disclosure") < at)).groupBy("entity").agg(F.min(F.struct((-F.col("disclosure")).alias("d"), "term")).alias("b"))
    kind = F.concat(F.lit("["), F.substring_index("entity", ":", 1), F.lit("]"))
    found = scored.where(F.col("disclosure") >= at).join(broad.select("entity", F.col("b.term").alias("general")), "entity", "left")
    return found.select("entity", "term", "disclosure", F.coalesce("general", kind).alias("general"))


def find_terms(base: DataFrame, disclosing: DataFrame) -> DataFrame:
    """``seq, terms``: the places of disclosing terms in the lines of the entities that they give away.

    A term that gives several entities of its line away follows the one that it discloses most.
    """
    lines = base.select("seq", F.explode("spans").alias("x")).select("seq", "x.entity", "x.line_start", "x.line").distinct()
    lines = lines.join(disclosing.select("entity").distinct(), "entity", "left_semi")
    tokens = lines.select("seq", "entity", "line_start", F.explode(located(F.col("line"), _WORD)).alias("t"))
    tokens = tokens.select("seq", "entity", F.lower("t.m").alias("term"), (F.col("line_start") + F.col("t.s")).alias("s"), (F.col("line_start") + F.col("t.e")).alias("e"))
    hits = tokens.join(disclosing, ["entity", "term"]).groupBy("seq", "s", "e").agg(F.max(F.struct("disclosure", "entity", "general")).alias("x"))
    return hits.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("s", "e", F.col("x.disclosure").alias("d"), F.col("x.general").alias("general")))).alias("terms"))


_TERMS = "array<struct<s:int,e:int,d:double,general:string>>"


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_col: str | None = None, **limits) -> DataFrame:
    """``id, seq, spans, terms``: base spans and, apart from them, the disclosing terms with what would stand for them."""
    base = staged(find_base(docs, id_col, text_col, seq_col), "privacy-base")
    disclosing = staged(disclosing_terms(docs, base, id_col, text_col, **limits), "privacy-disclosing")
    terms = find_terms(base, disclosing)
    found = base.join(terms, "seq", "left")
    apart = F.filter(F.coalesce("terms", F.array().cast(_TERMS)), lambda t: ~F.exists("spans", lambda x: (x["s"] < t["e"]) & (t["s"] < x["e"])))
    return found.select("id", "seq", "spans", apart.alias("terms"))


def replacement(t: Column, remove_at: float = REMOVE_AT) -> Column:
    """What stands for a disclosing term: nothing, or the general term."""
    return F.when(t["d"] >= remove_at, F.lit("")).otherwise(t["general"])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = REMOVE_AT, **limits) -> DataFrame:
    """``id, text``, a row for every row: base spans become their kind in brackets; terms are generalised or removed."""
    rows = staged(text_rows(docs, id_col, text_col).withColumn("seq", F.monotonically_increasing_id()), "privacy-in")
    found = find_personal(rows, "id", "text", "seq", **limits)
    base = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("["), x["kind"], F.lit("]")).alias("r")))
    terms = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), replacement(x, remove_at).alias("r")))
    rows = rows.join(found.select("seq", F.sort_array(F.concat(base, terms)).alias("cuts")), "seq")

    def step(acc, x):
        keep = F.substring(F.col("text"), acc["p"] + 1, x["s"] - acc["p"])
        made = F.struct(x["e"].alias("p"), F.concat(acc["t"], keep, x["r"]).alias("t"))
        return F.when(x["s"] >= acc["p"], made).otherwise(F.struct(F.greatest(acc["p"], x["e"]).alias("p"), acc["t"].alias("t")))

    rest = lambda acc: F.concat(acc["t"], F.substring(F.col("text"), acc["p"] + 1, F.length("text")))
    return rows.select("id", F.aggregate("cuts", F.struct(F.lit(0).alias("p"), F.lit("").alias("t")), step, rest).alias("text"))


def op10_pii_disclosure(spark, sf_dir: str) -> DataFrame:
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    named = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string")))
    terms = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"].cast("string"), x["e"].cast("string")))
    # start:end:remove, or start:end:generalise:word
    actions = F.transform("terms", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"), F.when(replacement(x) == "", "remove").otherwise(F.concat(F.lit("generalise:"), replacement(x)))))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *(count(k) for k in KINDS), F.sha2(F.array_join(named, ","), 256).alias("base_sha256"), F.array_join(F.concat(named, terms), ",").alias("spans"), F.array_join(actions, ",").alias("actions"), (F.size("spans") + F.size("terms")).cast("long").alias("n_spans"))
