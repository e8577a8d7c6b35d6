"""Personal information inside free text: e-mail addresses, telephone and identity numbers, addresses, names (problem 10).

Bootstrapped contextual extraction. One pass (`pii_scan`) finds what may be an entity, with its contexts. What a form
doesn't decide alone is decided by a graph of patterns (contexts) and instances (surnames, check results) over the whole
corpus, which Spark scores in rounds: seed patterns, labels that introduce a name, make the surnames they introduce
trusted; contexts that hold trusted surnames, many different ones and little else, become patterns; surnames that occur
mostly in such patterns become trusted; and so on. The patterns discover persons of surnames never seen in a label, the
surnames persons in contexts never seen. Contexts of identity numbers are scored by the share of right check characters
among what they introduce, so that stock and order numbers that happen to check are no cases. Where a trusted context stands on
both sides, or on the left with a sign on the right, persons of surnames that no list has are discovered. How far the name
of a Chinese address's first part reaches is scored likewise: a form of it is a name if DIFFERENT characters precede it.

At scale: texts are read once; candidates are written, a few dozen bytes each, and the graph is built from counts of
(context, surname), whose number depends on the language, not on the corpus. Sides of joins are small tables whose size
Spark checks itself; nothing is collected.

Defined results: null and empty texts have none; a text of any length is read whole; an entity inside an e-mail address
is none of its own; overlapping candidates of one kind count once; repeated rows give one row; columns of other names are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.pii_scan import UNLISTED, scan
from newsloom.tables import written

#: Seed patterns: labels that introduce a person's name.
SEEDS = (
    "L by", "L Photo:", "L Contact:", "L Von", "L Sprecherin", "L Sprecher", "L Ms.", "L Mr.", "L Mrs.", "L Frau", "L Herr", "l系人：", "l编辑：", "l供图：", "l摄影：", "l报记者", "l者 ", "l记者 ",
)
#: Different trusted surnames that make a context a pattern, and their least share of what it holds.
DIFFERENT, PURE, PURE_CHINESE = 4, 0.6, 0.9
#: Share of the patterns of the most widespread Chinese surname that another must follow.
SPREAD = 0.2
#: Share of a surname's occurrences that must lie in patterns.
SURE = 0.2
#: Share of the occurrences of an address's first part that a longer form of its name must have.
FORM = 0.8
#: Share of right check characters that makes a context introduce identity numbers.
CHECKED = 0.5
KINDS = ("email", "phone", "id", "address", "name")
_SCHEMA = "doc_id long, kind string, start int, end int, l string, r string, token string"


def candidates(docs: DataFrame) -> DataFrame:
    """What `pii_scan.scan` finds in (doc_id, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "kind", "start", "end", "l", "r", "token"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            out: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.extend((d, *c) for c in scan(t))
                if len(out) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out), types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").filter("text IS NOT NULL AND text <> ''").mapInArrow(find, _SCHEMA)


def graph(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, surnames) that the rounds of scoring accept, from name candidates."""
    part = F.explode(F.split("token", "-"))
    edges = names.select("l", "r", part.alias("token")).groupBy("l", "r", "token").agg(F.count("*").alias("n"))
    sides = edges.select(F.explode(F.array("l", "r")).alias("pattern"), "token", "n").groupBy("pattern", "token").agg(F.sum("n").alias("n"))
    sides = written(sides, "contexts")
    edges = written(edges, "edges")
    patterns = sides.filter(F.col("pattern").isin(*SEEDS)).select("pattern").distinct()
    everywhere = edges.groupBy("token").agg(F.sum("n").alias("all"))
    surnames, seen = None, set()
    while True:
        hit = F.coalesce(F.col("_l"), F.lit(0)) + F.coalesce(F.col("_r"), F.lit(0)) > 0
        known = edges.join(patterns.select(F.col("pattern").alias("l"), F.lit(1).alias("_l")), "l", "left").join(patterns.select(F.col("pattern").alias("r"), F.lit(1).alias("_r")), "r", "left")
        inside = known.filter(hit).groupBy("token").agg(F.sum("n").alias("n"), F.count_distinct(F.when(F.col("_l") == 1, F.col("l"))).alias("k"))
        # a Chinese surname is a word as well and must follow several patterns, a capital word must be a name mostly
        chinese = F.col("token").rlike("^[一-鿿]")
        inside = written(inside, "inside")
        most = inside.filter(chinese).agg(F.max("k")).first()[0] or 0
        trusted = F.when(chinese, F.col("k") >= max(2, SPREAD * most)).otherwise((F.col("n") >= 2) & (F.col("n") >= SURE * F.col("all")))
        surnames = written(inside.join(everywhere, "token").filter(trusted).select("token"), "surnames")
        held = sides.join(surnames.withColumn("_ok", F.lit(1)), "token", "left").groupBy("pattern")
        held = held.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("_ok") == 1, F.col("n"))).alias("n"), F.count("_ok").alias("k"))
        # a context of fewer characters than three, or cut by a text's begin or end, is no pattern
        enough = (F.col("k") >= DIFFERENT) & (F.col("n") >= F.when(F.col("pattern").rlike("^[lr]"), PURE_CHINESE).otherwise(PURE) * F.col("all")) & (F.length("pattern") >= 4)
        patterns = written(held.filter(enough | F.col("pattern").isin(*SEEDS)).select("pattern"), "patterns")
        # until the patterns are those of an earlier round
        now = tuple(patterns.agg(F.count("*"), F.bit_xor(F.xxhash64("pattern"))).first())
        if now in seen:
            return patterns, surnames
        seen.add(now)


def _names(found: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, sure: names; sure: what follows is a pattern."""
    names, listed = found.filter("kind = 'name'"), ~F.col("token").startswith(UNLISTED)
    patterns, surnames = graph(names.filter(listed))
    marked = names.join(patterns.select(F.col("pattern").alias("l"), F.lit(True).alias("_l")), "l", "left").join(patterns.select(F.col("pattern").alias("r"), F.lit(True).alias("_r")), "r", "left")
    whole = surnames.select(F.col("token").alias("_last"), F.lit(True).alias("_known"))
    marked = marked.withColumn("_last", F.element_at(F.split("token", "-"), -1)).join(whole, "_last", "left")
    chinese = F.col("token").rlike("^[一-鿿]")
    context = F.coalesce(F.col("_l"), F.lit(False)) | F.coalesce(F.col("_r"), F.lit(False))
    known = F.coalesce(F.col("_known"), F.lit(False))
    # what no list has is discovered where patterns stand on both sides, or a sign or the text's end follows one
    after = F.coalesce(F.col("_r"), F.lit(False)) | ~F.col("r").rlike("^r[一-鿿]")
    new = ~listed & F.coalesce(F.col("_l"), F.lit(False)) & after
    return marked.filter((known & (~chinese | context)) | new).select("doc_id", "kind", "start", "end", F.coalesce(F.col("_r"), F.lit(False)).alias("sure"))


def _chinese_addresses(found: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, sure: addresses with the name of their first part as long as the corpus says."""
    own = found.filter("kind = 'address' AND token = 'zh'")
    size = F.length("l")
    forms = own.select("doc_id", "start", "end", "l", "r", F.explode(F.sequence(F.lit(0), size)).alias("x"))
    forms = forms.withColumn("form", F.concat(F.right("l", F.col("x")), "r")).withColumn("before", F.substr("l", F.length("l") - F.col("x"), F.lit(1)))
    scores = forms.groupBy("form").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("before") != "", F.col("before"))).alias("k"))
    scored = forms.join(scores, "form").groupBy("doc_id", "start", "end").agg(F.sort_array(F.collect_list(F.struct("x", "n", "k"))).alias("s"))
    whole = F.filter("s", lambda f: (f["k"] >= DIFFERENT) & (f["n"] >= FORM * F.element_at("s", 1)["n"]))
    x = F.coalesce(F.get(whole, F.lit(0))["x"], F.lit(0))
    return scored.select("doc_id", F.lit("address").alias("kind"), (F.col("start") - x).alias("start"), "end", F.lit(False).alias("sure"))


def _identity(found: DataFrame) -> DataFrame:
    ids = found.filter("kind = 'id'")
    contexts = ids.groupBy("l").agg(F.avg((F.col("token") == "good").cast("double")).alias("_right"))
    return ids.filter("token = 'good'").join(contexts.filter(F.col("_right") >= CHECKED), "l").select("doc_id", "kind", "start", "end", F.lit(False).alias("sure"))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end: characters from 1, end excluded, of every occurrence in (doc_id, text)."""
    found = written(candidates(docs), "candidates")
    sure = found.filter("kind IN ('email', 'phone') OR kind = 'address' AND token <> 'zh'").select("doc_id", "kind", "start", "end", F.lit(False).alias("sure"))
    spans = sure.unionByName(_chinese_addresses(found)).unionByName(_names(found)).unionByName(_identity(found))
    # of spans of one kind that begin alike the one before a pattern, else the longest
    spans = spans.groupBy("doc_id", "kind", "start").agg(F.max_by("end", F.struct("sure", "end")).alias("end"))
    before = Window.partitionBy("doc_id", "kind").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_upto", F.max("end").over(before)).filter(F.col("_upto").isNull() | (F.col("_upto") <= F.col("start")))
    return spans.select("doc_id", "kind", (F.col("start") + 1).cast("long").alias("start"), (F.col("end") + 1).cast("long").alias("end"))


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, text: entities replaced by placeholders of their kind, the rest of the text as it is."""
    spans = entities(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_spans"))

    @F.pandas_udf("string")
    def replace(texts, spans):  # type: ignore[no-untyped-def]
        def one(text, found):  # type: ignore[no-untyped-def]
            if text is None or found is None or not len(found):
                return text
            out, at = [], 0
            for s in found:
                if s["start"] - 1 >= at:
                    out += [text[at : s["start"] - 1], f"[{s['kind'].upper()}]"]
                    at = s["end"] - 1
            return "".join([*out, text[at:]])

        return texts.combine(spans, one)

    return docs.select(F.col("doc_id").cast("long"), "text").join(spans, "doc_id", "left").select("doc_id", replace("text", "_spans").alias("text"))
