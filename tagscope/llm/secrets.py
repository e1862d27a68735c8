"""Secret scans with multipart credential linking (native expressions only).

Strong spans (kinds assign, access, hex) are reported wherever they occur.
Weak candidates (kinds secret, endpoint, ident) are too common to report on
their own: an interval join brings together the parts of one scope, and a weak
candidate is reported only when the parts it needs co-occur with it.

| weak kind | looks like | reported when in scope there is |
| --- | --- | --- |
| secret | 32 or more base64 characters with upper, lower case and a digit | an identifier (access, ident) |
| ident | user, login, account or client id followed by a value | a secret part (assign, hex, secret) |
| endpoint | a URL, or host and port | an identifier and a secret part |

The patterns run once over a text.  Their matches become rows (place among the
matches, length of the text before, own length), positions are running sums over one
text's matches of one kind, and everything after that joins and groups small rows:
the work follows the text's length and its number of matches, not their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagscope.llm.common import Renamed, id_key, staged

SCOPE = 256            # code points between two parts of one credential, at most
MARK = "[SECRET]"
# The strong patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LONG = r"[0-9a-f]{24,}"   # the same runs, only those long enough
# The weak patterns.
SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,}+={0,2}"
ENDPOINT = r"""(?:https?|s3|ftp)://[A-Za-z0-9][^\x20\x09-\x0D"'<>]*+|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}:[0-9]{2,5}"""
IDENT = r"""(?i:\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
STRONG = ("assign", "access", "hex")
KINDS = (*STRONG, "secret", "endpoint", "ident")
NO_SPANS = "array<struct<kind:string,start:int,end:int>>"


PATTERNS = {"assign": (ASSIGN, 6), "access": (ACCESS, 20), "hex": (HEX_LONG, 24), "secret": (SECRET, 1), "endpoint": (ENDPOINT, 1),
            "ident": (IDENT, 1)}


def hits(docs: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per leftmost non-overlapping match of every kind: keys, kind, place
    (from 0), gap (code points since the match before), size, long (its value reaches
    the kind's least length).  Texts without a match cost their patterns only."""
    caught = docs.select(*keys, text.alias("_text"), *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{k}") for k, (p, _) in PATTERNS.items()])
    kinds = []
    for kind, (pattern, least) in PATTERNS.items():
        all_ = F.col(f"_{kind}")
        gaps = F.transform(F.split("_text", pattern, -1), F.char_length)
        rows = F.transform(all_, _describe(kind, least))
        some = F.arrays_zip(rows.alias("m"), F.slice(gaps, F.lit(1), F.size(all_)).alias("gap"))
        kinds.append(F.when(F.size(all_) > 0, some).otherwise(F.array().cast(HITS)))
    return caught.select(*keys, F.explode(F.concat(*kinds)).alias("h")).select(*keys, "h.m.*", F.col("h.gap").alias("gap"))


def _describe(kind: str, least: int):
    """What is kept of a match; the value of an assignment is its second group."""
    def describe(match, place):
        value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
        return F.struct(F.lit(kind).alias("kind"), place.alias("place"), F.char_length(match).alias("size"),
                        (F.char_length(value) >= least).alias("long"))
    return describe


HITS = "array<struct<m:struct<kind:string,place:int,size:int,long:boolean>,gap:int>>"


def positions(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, start, end of the matches that are long enough.  The running sums
    span the matches of one kind in one text; equal texts of one id count once."""
    w = Window.partitionBy(*keys, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = found.dropDuplicates([*keys, "kind", "place"]).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(w).cast("int"))
    return spans.where("long").select(*keys, "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _in_buckets(spans: DataFrame, width: int, reach: int = 0) -> DataFrame:
    return spans.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("start") - reach) / width), F.floor((F.col("end") + reach) / width))))


def untouched(spans: DataFrame, keys: list[str], width: int = SCOPE) -> DataFrame:
    """Strong spans, and the weak ones that touch no strong one (one that does says
    nothing new)."""
    strong, weak = spans.where(F.col("kind").isin(*STRONG)), spans.where(~F.col("kind").isin(*STRONG))
    other = _in_buckets(strong, width).select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_bucket").alias("_o_bucket"),
                                              F.col("start").alias("_o_start"), F.col("end").alias("_o_end"))
    meets = [F.col(k) == F.col(f"_o_{k}") for k in keys] + [F.col("_bucket") == F.col("_o_bucket"),
                                                          F.col("_o_start") < F.col("end"), F.col("start") < F.col("_o_end")]
    touched = _in_buckets(weak, width).join(other, meets, "left_semi").select(*spans.columns).distinct()
    return strong.unionByName(weak.join(touched, spans.columns, "left_anti"))


def link(parts: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """The weak spans of ``parts`` (keys, kind, start, end) that the rules above
    report.  Interval join: both sides are dealt to position buckets as wide as
    the scope, partners also to those within reach, so only neighbours meet and
    the pairs of a bucket are bounded by what fits into a scope."""
    partner = _in_buckets(parts, scope, scope).select(
        *[F.col(k).alias(f"_p_{k}") for k in keys], F.col("_bucket").alias("_p_bucket"),
        F.when(F.col("kind").isin("access", "ident"), "id").when(F.col("kind") != "endpoint", "key").alias("_p_role"),
        F.col("start").alias("_p_start"), F.col("end").alias("_p_end")).where("_p_role is not null")
    weak = _in_buckets(parts.where(~F.col("kind").isin(*STRONG)), scope)
    on = [F.col(k) == F.col(f"_p_{k}") for k in keys] + [F.col("_bucket") == F.col("_p_bucket")]
    close = (F.col("_p_start") - F.col("end") <= scope) & (F.col("start") - F.col("_p_end") <= scope)
    met = weak.join(partner, on).where(close).groupBy(*keys, "kind", "start", "end").agg(
        F.max(F.col("_p_role") == "id").alias("_id"), F.max(F.col("_p_role") == "key").alias("_key"))
    return met.where((F.col("kind") == "secret") & F.col("_id") | (F.col("kind") == "ident") & F.col("_key")
                     | (F.col("kind") == "endpoint") & F.col("_id") & F.col("_key")).select(*keys, "kind", "start", "end")


KEYS = ["_sec_id", "_sec_hash", "_sec_len"]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("_sec_id", id_key(F.col(doc_id))).withColumn("_sec_hash", F.xxhash64(t)).withColumn("_sec_len", F.length(t))


def span_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """KEYS, kind, start, end of every reported span, once per different (id, text)."""
    found = staged(hits(_keyed(docs.select(doc_id, text), doc_id, text), KEYS, F.coalesce(F.col(text), F.lit(""))), "secret-hits")
    parts = staged(untouched(positions(found, KEYS), KEYS, scope), "secret-parts")
    strong = parts.where(F.col("kind").isin(*STRONG))
    return strong.unionByName(link(parts, KEYS, scope))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (kind, start, end) by start,
    then kind as listed in ``KINDS``; positions in code points, end exclusive.

    Null text counts as empty (no spans).  Rows are told apart by id and a hash
    of the text, so repeated ids and repeated rows get their own right result
    and null ids work too.  Other columns pass through; one called
    secret_spans, or starting with "_sec", is replaced.  No row is dropped.
    """
    place = F.create_map(*[F.lit(x) for kv in {k: i for i, k in enumerate(KINDS)}.items() for x in kv])
    rows = span_rows(docs, doc_id, text, scope)
    lists = rows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("start", place[F.col("kind")].alias("k"), "end", "kind"))).alias("_secret_list"))
    lists = lists.select(*[F.col(k).alias(f"_l{k}") for k in KEYS], F.transform("_secret_list", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("_secret_list"))
    keyed = _keyed(docs.drop("secret_spans"), doc_id, text)
    joined = keyed.join(lists, [F.col(k) == F.col(f"_l{k}") for k in KEYS], "left")
    return joined.withColumn("secret_spans", F.coalesce("_secret_list", F.array().cast(NO_SPANS))) \
        .drop("_secret_list", *KEYS, *[f"_l{k}" for k in KEYS])


def joined_spans(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def strong_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*STRONG))


BLOCK = 4096     # code points of a text that are masked together


def mask_cuts(spans: DataFrame) -> DataFrame:
    """Per text (``_l`` keys) the stretches that spans cover, cut to blocks of the
    text: a map from block number to (from, to, begins) inside the block, sorted."""
    before = Window.partitionBy(*KEYS).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*KEYS).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # spans that overlap one before belong to its stretch
    begun = spans.withColumn("_new", (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")).cast("int"))
    stretches = begun.withColumn("_no", F.sum("_new").over(so_far)).groupBy(*KEYS, "_no").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    b = F.col("b")
    cut = stretches.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / BLOCK).cast("int"), F.floor((F.col("e") - 1) / BLOCK).cast("int")))) \
        .select(*KEYS, "b", F.struct(F.greatest(F.col("s") - b * BLOCK, F.lit(0)).alias("lo"),
                                     F.least(F.col("e") - b * BLOCK, F.lit(BLOCK)).alias("hi"), (F.col("s") >= b * BLOCK).alias("begins")).alias("c"))
    blocks = cut.groupBy(*KEYS, "b").agg(F.sort_array(F.collect_list("c")).alias("cuts"))
    return blocks.groupBy(*[F.col(k).alias(f"_l{k}") for k in KEYS]).agg(F.map_from_entries(F.collect_list(F.struct("b", "cuts"))).alias("_cuts"))


def masked(text: Column, cuts: Column, mark: str = MARK) -> Column:
    """The text with every stretch of ``cuts`` replaced by one mark (null cuts: as it
    is).  A block's pieces are taken from the block, so a text's length counts once."""
    def one(block, held):
        def piece(c, j):
            at = F.when(j == 0, F.lit(0)).otherwise(F.try_element_at(held, j)["hi"])
            return F.concat(F.substr(block, at + 1, c["lo"] - at), F.when(c["begins"], F.lit(mark)).otherwise(F.lit("")))
        return F.concat(F.array_join(F.transform(held, piece), ""), F.substr(block, F.element_at(held, -1)["hi"] + 1, F.lit(BLOCK)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = F.transform(blocks, lambda block, i: F.coalesce(one(block, F.try_element_at(cuts, i)), block))
    return F.when(cuts.isNotNull(), F.array_join(whole, "")).otherwise(text)


def mask_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all secrets masked in the text (``n_chars``, where there is
    such a column, follows); same rows and columns."""
    names = Renamed(docs)
    ident, body = names.name(doc_id), names.name(text)
    cuts = mask_cuts(span_rows(names.df, ident, body))
    out = _keyed(names.df, ident, body).join(cuts, [F.col(k) == F.col(f"_l{k}") for k in KEYS], "left")
    out = out.withColumn(body, masked(F.col(body), F.col("_cuts")))
    if "n_chars" in docs.columns:
        size = names.name("n_chars")
        n = F.when(F.col("_cuts").isNotNull(), F.length(body).cast(names.df.schema[size].dataType))
        out = out.withColumn(size, F.coalesce(n, F.col(size)))
    return names.back(out)
