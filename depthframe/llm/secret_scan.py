"""Secret scans with DataFrame operations only: pattern hits plus corpus-wide ownership frequency.

Base hits come from fixed patterns. Wider *candidates* (long mixed tokens of any alphabet that the patterns don't
name) are hashed, and the hashes are counted over the corpus by distinct repositories and distinct owners. A value that
fewer than ``EXAMPLE_OWNERS`` owners hold, in however many repositories, and that looks random is live-looking: its
candidates become spans of kind ``live``. A value that more owners hold is a widely copied example: it is reported, and
adds nothing. Base hits stay whatever the counts say; the class of every hit is reported beside it.

How it scales. A scan goes over each text four times a pattern (whether it is there, its matches, their values, the text
between them) and writes only its hits; the time for n hits of a text grows as n ** 1.5. Counts go by (value, owner) first,
with partial sums, and by value then, so a value that a third of all rows hold is a few rows per task before any
shuffle. What is joined back is joined on the value's hash, where Spark can split a hot value.

Positions are code points. Java's ``split`` at a pattern gives the text between its matches, so running sums of the
lengths of both give every match's place without a Python function.

Defined cases: null text is empty; null owner or repository counts as one of its own; equal rows give equal results
(they are told apart by a row number, not joined to each other); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Base patterns in their listed order: kind, pattern, group that is the value, least length of that value.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
#: Candidates for ``live``: whole tokens of the usual credential alphabets.
CANDIDATE = ("live", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: A value that so many owners hold is an example.
EXAMPLE_OWNERS = 3
#: Least number of different characters in a value that looks random; fewer where only 16 are in use.
VARIED, VARIED_HEX = 10, 6

SPAN = "array<struct<kind:string,rank:int,start:int,end:int,value:string>>"


def find_all(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches as an array of (kind, rank, start, end, value); shorter values dropped."""
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, regex, F.lit(group))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))
    begun = lambda at, found, kind: F.struct(at.alias("at"), found.cast(kind).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def placed(all_pairs: Column) -> Column:
        # An array is copied when one more is put to it. So n pairs go by runs of about the root of n, and runs are put together.
        width = F.ceil(F.sqrt(F.size(all_pairs))).cast("int")
        runs = F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / width).cast("int"))

        def run(acc: Column, k: Column) -> Column:
            ended = lambda own: begun(own["at"], F.concat(acc["found"], F.array(own["found"])), f"array<{SPAN}>")
            return F.aggregate(F.slice(all_pairs, k * width + 1, width), begun(acc["at"], F.lit([]), SPAN), step, ended)

        return F.aggregate(runs, begun(F.lit(0), F.lit([]), f"array<{SPAN}>"), run, lambda acc: F.flatten(acc["found"]))

    # The pairs are one element of an array, so that they are made once though they are named several times.
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(pairs), placed), F.lit(0))).otherwise(F.lit([]).cast(SPAN))


def looks_random(value: Column) -> Column:
    """Letters and digits, many different characters, a fair share of digits: not a word, number, rule or path."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    varied = F.when(value.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z"), VARIED_HEX).otherwise(VARIED)
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= varied) & (F.length(F.regexp_replace(value, "[^0-9]", "")) * 12 >= F.length(value))


def joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def hits(docs: DataFrame, owner: str, repository: str, *keys: Column) -> DataFrame:
    """keys, owner, repository, base and wide of every row. A hit holds its place, where its value starts, the value's
    SHA-256 (no credential is copied about) and whether the value looks random."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(*keys, F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("null")).alias("owner"), F.coalesce(F.concat(F.lit("="), F.col(repository).cast("string")), F.lit("null")).alias("repository"), text.alias("__text"))
    text = F.col("__text")

    def hidden(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), (s["end"] - F.length(s["value"])).alias("value_start"), F.sha2(s["value"], 256).alias("hash"), looks_random(s["value"]).alias("random"))

    base = F.transform(F.concat(*[find_all(text, k, *kind) for k, kind in enumerate(KINDS)]), hidden)
    wide = F.filter(F.transform(find_all(text, len(KINDS), *CANDIDATE), hidden), lambda s: s["random"])
    return named.withColumn("base", base).withColumn("wide", wide).drop("__text")


def ownership(spans: DataFrame, example_owners: int) -> DataFrame:
    """hash, owners, repositories (distinct ones that hold the value) and its class, from rows of (hash, owner, repository)."""
    places = spans.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    counts = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    return counts.withColumn("class", F.when(F.col("owners") < example_owners, "live").otherwise("example"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of docs: doc_id, base (spans), added (spans), values (class and counts of each value).

    ``owner`` and ``repository`` name the columns that say who holds a text and where.
    """
    found = hits(docs, owner, repository, F.col("doc_id").alias("doc_id"))
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "secret-hits")
    spans = found.where(F.size("base") + F.size("wide") > 0).select("row", "owner", "repository", F.explode(F.concat("base", "wide")).alias("s"))
    span = F.when(F.col("s.kind") == CANDIDATE[0], F.struct("s.kind", "s.rank", "s.start", "s.end"))
    keyed = spans.select("row", "owner", "repository", "s.hash", span.alias("span"))
    judged = keyed.select("row", "hash", "span").join(ownership(keyed, example_owners), "hash")
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("class") == "live", F.col("span"))).alias("added"),
        F.collect_set(F.struct("hash", "class", "owners", "repositories")).alias("values"),
    )
    none = F.lit([])
    return found.join(per_row, "row", "left").select(
        "doc_id",
        "base",
        F.coalesce("added", none.cast("array<struct<kind:string,rank:int,start:int,end:int>>")).alias("added"),
        F.coalesce("values", none.cast("array<struct<hash:string,class:string,owners:bigint,repositories:bigint>>")).alias("values"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The result columns of the scan's query."""
    base = F.col("base")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    everything = F.concat(*[F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"))) for c in (base, F.col("added"))])
    return found.select("doc_id", *[count(k[0]) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(everything).alias("spans"), F.size("added").cast("long").alias("n_live"), F.size(F.filter("values", lambda v: v["class"] == "example")).cast("long").alias("n_examples"))


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mark: str = "[secret]", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs with every live-looking value replaced in its text; values that many owners hold stay, and so does every row.

    The columns and their order stay; n_chars, where there is one, follows the text. The patterns read each text once: rows
    are written with their hits, and only rows with a hit are shuffled.
    """
    row = F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias("row")
    found = hits(docs, owner, repository, row).withColumn("__id", F.monotonically_increasing_id())
    suspect = lambda s: s["random"] | s["kind"].isin("assign", "access")
    place = lambda s: F.struct(s["hash"].alias("hash"), s["value_start"].alias("value_start"), s["end"].alias("end"))
    found = found.select("__id", "row", "owner", "repository", F.transform(F.filter(F.concat("base", "wide"), suspect), place).alias("__hits"))
    found = materialize(found, "secret-rows")
    spans = found.where(F.size("__hits") > 0).select("__id", "owner", "repository", F.explode("__hits").alias("s")).select("__id", "owner", "repository", "s.*")
    live = ownership(spans, example_owners).where(F.col("class") == "live").select("hash")
    cuts = spans.join(live, "hash").groupBy("__id").agg(F.sort_array(F.collect_set(F.struct("value_start", "end"))).alias("__cuts"))

    touched = found.where(F.size("__hits") > 0).select("__id", "row").join(cuts, "__id", "left").select("row", "__cuts")
    text = F.col("row.text").cast("string")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        upto = F.greatest(s["value_start"], acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, upto - acc["at"]), F.lit(mark)).alias("out"))
        return F.when(s["end"] > acc["at"], new).otherwise(acc)

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.aggregate("__cuts", begin, cut, rest)
    changed = F.col("row").withField("text", clean.cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(clean).cast(docs.schema["n_chars"].dataType))
    touched = touched.select(F.when(F.col("__cuts").isNull(), F.col("row")).otherwise(changed).alias("row"))
    return found.where(F.size("__hits") == 0).select("row").unionByName(touched).select("row.*")
