"""Document fingerprints: canonical exact digests.

A text is put into canonical form (NFKC, case folding, white space runs to one
blank, ends trimmed) and digested with 128-bit XXH3.  Equal digests form a
bucket; inside a bucket of several documents the canonical bytes themselves are
compared (grouped, copies meeting before the shuffle), and should two different
texts ever share a digest the later one, in byte order, gets a suffix.

``edited`` also digests a text whose second half is replaced by the beginning of
the next document in doc_id order.  Documents are dealt into ranges of doc_id
whose bounds are quantiles (which are ids that occur), the first document of
each range is also sent to the range before, and each range is streamed in
order: one shuffle of the texts, two texts in memory.

A null text is empty; an empty table gives none; null doc_ids come first,
repeated doc_ids and repeated rows follow each other in the order of their
texts' hash; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hint_by_size, materialize

RANGE_ROWS = 256
MAX_RANGES = 65536
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fp string, control string, edited_fp string, edited_control string, "
    "near_edited double, near_next double"
)


def canonical(text: str) -> bytes:
    """NFKC, case folded, white space collapsed."""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digests(form: bytes, digits: int = 32) -> tuple[str, str]:
    """The fingerprint, and a second digest that only serves to tell members of a bucket apart."""
    return xxhash.xxh3_128_hexdigest(form)[:digits], xxhash.xxh3_128_hexdigest(form, seed=1)


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _stream(digits: int):
    def row(current, following):
        doc_id, text, form, (fp, control) = current
        changed = edit(text, following[1])
        changed_form = canonical(changed)
        efp, econtrol = digests(changed_form, digits)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), sha, fp, control, efp, econtrol, float(form == changed_form), float(form == following[2]))

    def run(batches):
        previous, at, out, size = None, None, [], 0
        for b in batches:
            for i in range(b.num_rows):
                group, role, doc_id, text = (b.column(c)[i].as_py() for c in range(4))
                if group != at:
                    previous, at = None, group
                elif previous is None:
                    continue  # the rest of the next range's head
                form = canonical(text)
                current = (doc_id, text, form, digests(form, digits))
                if previous is not None:
                    out.append(row(previous, current))
                previous = None if role else current
                if len(out) >= 1024:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _range_of(doc_id: Column, bounds: list[int]) -> tuple[Column, Column]:
    """Number of bounds up to ``doc_id``, and whether it is one; found in two steps over at most 256 + 256 bounds."""
    step = 256
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[k : k + step]]) for k in range(0, len(bounds), step)])
    block = F.size(F.filter(coarse, lambda b: b <= doc_id))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(block, F.lit(1))), lambda b: b <= doc_id))
    number = F.when(doc_id.isNull(), 0).otherwise((block - 1) * step + inside)
    head = F.get(F.element_at(fine, F.greatest(block, F.lit(1))), F.greatest(inside - 1, F.lit(0))) == doc_id
    return number, F.coalesce(head, F.lit(False))


def edited(docs: DataFrame, text: str = "text", digits: int = 32) -> DataFrame:
    """Digests of every text and of its edited text; see the module's text.  Written to the shared folder."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = source.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    ranges = max(1, min(MAX_RANGES, rows["known"] // RANGE_ROWS))
    points = [k / ranges for k in range(ranges)]
    found = source.agg(F.percentile_approx("doc_id", points, max(10_000, 10 * ranges)), F.min("doc_id")).first()
    bounds = sorted({found[1], *(found[0] or [])}) if rows["known"] else [0]
    number, head = _range_of(F.col("doc_id"), bounds)
    last = len(bounds) if rows["known"] else 0
    nulls = rows["n"] > rows["known"]
    placed = source.withColumn("grp", number).withColumn("head", head)
    # The first range follows the null ids; what comes first of all follows the last range.
    first_of_all = F.col("grp") == (0 if nulls else 1)
    before = F.when(first_of_all, F.lit(last)).when(F.col("head"), F.col("grp") - 1)
    places = F.array(F.struct(F.col("grp").alias("grp"), F.lit(0).alias("role")), F.struct(before.cast("int").alias("grp"), F.lit(1).alias("role")))
    copied = F.when(F.col("head") | F.col("grp").eqNullSafe(0), F.slice(places, 1, 2)).otherwise(F.slice(places, 1, 1))
    copied = F.filter(copied, lambda p: p["grp"].isNotNull())
    dealt = placed.select(F.explode(copied).alias("p"), "doc_id", "text").select("p.grp", "p.role", "doc_id", "text")
    ordered = dealt.withColumn("h", F.xxhash64("text")).repartition("grp").sortWithinPartitions("grp", "role", "doc_id", "h", "text")
    return materialize(ordered.select("grp", "role", "doc_id", "text").mapInArrow(_stream(digits), SCHEMA), "fingerprints")


def collisions(docs: DataFrame, out: DataFrame, text: str = "text", digits: int = 32) -> DataFrame:
    """(fp, control, variant) of canonical texts that are not the first of their bucket: buckets' bytes are compared.

    Only texts whose digest several documents share are read again.
    """

    def forms(batches):
        for b in batches:
            made = [canonical(t.as_py()) for t in b.column(0)]
            names = [digests(f, digits) for f in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n[0] for n in names]), pa.array([n[1] for n in names]), pa.array(made, pa.binary())], ["fp", "control", "form"]
            )

    # Written first: with a plain exchange on either side Spark splits a bucket that many copies share.
    shared = materialize(out.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "fingerprint-shared")
    members = materialize(out.join(shared, "fp", "left_semi").select(F.col("doc_id").alias("_id")).distinct(), "fingerprint-members")
    texts = docs.join(hint_by_size(members), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    texts = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    distinct = texts.mapInArrow(forms, "fp string, control string, form binary").groupBy("fp", "form").agg(F.min("control").alias("control"))
    order = Window.partitionBy("fp").orderBy("form")
    several = distinct.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    if several.isEmpty():
        return several.select("fp", F.lit("").alias("control"), F.lit(0).alias("variant")).limit(0)
    ranked = distinct.join(several, "fp", "left_semi").select("fp", "control", (F.row_number().over(order) - 1).alias("variant"))
    return materialize(ranked.where("variant > 0"), "fingerprint-variants")


def fingerprint(docs: DataFrame, text: str = "text", digits: int = 32) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    out = edited(docs, text, digits)
    variants = collisions(docs, out, text, digits)
    if not variants.isEmpty():
        for fp, control in (("fp", "control"), ("edited_fp", "edited_control")):
            named = variants.select(F.col("fp").alias("_fp"), F.col("control").alias("_control"), "variant")
            out = out.join(named, (F.col(fp) == F.col("_fp")) & (F.col(control) == F.col("_control")), "left").withColumn(
                fp, F.when(F.col("variant").isNotNull(), F.concat_ws("-", fp, "variant")).otherwise(F.col(fp))
            ).drop("_fp", "_control", "variant")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next"
    )
