"""Ground truth from token annotations, manifests, pages, paired files and item lists, with reports of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.functions.runs import image_reference
from gridscore.functions.textnorm import file_stem, file_suffix, let
from gridscore.operators.convert import convert_responses
from gridscore.operators.ordinal import amount_before
from gridscore.sources.schemas import ITEM
from gridscore.sources.sizes import few

# Fixed value: the image files that are taken.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp")


def tokens_to_html(tokens: Column, cells: Column) -> Column:
    """The i-th cell's tokens before the i-th closing cell tag; surplus closers stay empty, surplus cells are left out."""
    pieces = F.split(F.array_join(tokens, ""), "(?=</t[dh]>)", -1)
    texts = F.transform(cells, lambda c: F.array_join(F.coalesce(c["tokens"], F.array().cast("array<string>")), ""))
    body = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(texts, i - 1), F.lit("")), p)))
    return F.concat(F.lit("<html><body><table>"), F.array_join(body, ""), F.lit("</table></body></html>"))


def token_samples(annotations: DataFrame, images: DataFrame, dataset: str, split: str = "val") -> DataFrame:
    """Samples of one split; images: (name). meta tells the split, the image id and whether the image is missing."""
    own = annotations.where(F.col("split") == split)
    there = images.select(F.col("name").alias("filename")).distinct().withColumn("__there", F.lit(True))
    rows = own.join(there.hint("merge"), "filename", "left")
    missing = F.when(F.col("__there"), "false").otherwise("true")
    return rows.select(F.lit(dataset).alias("dataset"), file_stem(F.col("filename")).alias("sample_id"), F.col("filename").alias("image"), tokens_to_html(F.col("html.structure.tokens"), F.col("html.cells")).alias("gt_html"), F.create_map(F.lit("split"), "split", F.lit("imgid"), F.col("imgid").cast("string"), F.lit("missing_image"), missing).alias("meta"))


def reconcile_inventory(annotated: DataFrame, images: DataFrame, name: str = "name") -> DataFrame:
    """(kind, name, n): rows gt_count and image_count (n, no name), and a row missing_image or extra_image for each name that only one side has."""
    a, b = annotated.select(name).distinct(), images.select(name).distinct()
    counted = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("name"), "n")
    listed = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.lit(None).cast("long").alias("n"))
    only = lambda x, y: x.join(y.hint("merge"), name, "left_anti")
    return counted(annotated, "gt_count").union(counted(b, "image_count")).union(listed(only(a, b), "missing_image")).union(listed(only(b, a), "extra_image"))


def manifest_samples(manifest: DataFrame, images: DataFrame, truths: DataFrame, dataset: str, revision: str | None = None) -> DataFrame:
    """Entries whose image and truth exist. images: (image); truths: (gt, value). meta is the entry's whole record, where the manifest has it, and the revision."""
    rows = manifest.join(images.select("image").distinct().hint("merge"), "image", "left_semi").join(truths.groupBy("gt").agg(F.max("value").alias("__truth")).hint("merge"), "gt")
    own = F.map_filter(F.col("record"), lambda k, _: k != "dataset_revision") if "record" in manifest.columns else F.create_map(F.lit("source"), "source")
    meta = F.map_concat(own, F.create_map(F.lit("dataset_revision"), F.lit(revision).cast("string")))
    return rows.select(F.lit(dataset).alias("dataset"), F.col("id").alias("sample_id"), "image", F.col("__truth").alias("gt_html"), meta.alias("meta"))


def manifest_missing(manifest: DataFrame, images: DataFrame, truths: DataFrame) -> DataFrame:
    """Ids (the image where there is none) of entries without image or truth."""
    rows = manifest.join(images.select("image", F.lit(True).alias("__i")).distinct().hint("merge"), "image", "left").join(truths.select("gt", F.lit(True).alias("__t")).distinct().hint("merge"), "gt", "left")
    return rows.where("__i IS NULL OR __t IS NULL").select(F.coalesce("id", "image").alias("missing"))


def zip_elements(text: Column, left: Column, right: Column) -> Column:
    """Pairs of the i-th elements of two arrays, as many as both have."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, 1, n), lambda a, b: F.struct(a.alias("left"), b.alias("right")))


_TABLE_TAG = r"(?i)</?table\b[^>]*>"


def table_elements(text: Column) -> Column:
    """The tables of a page in the order in which they begin, each to its own end tag; a table that stays open goes to the page's end.

    A table inside a table is an element of its own and part of the outer one. Tags are counted by one fold over them, with
    a stack of the tables that are open.
    """
    def cut(page):
        tags = F.regexp_extract_all(page, F.lit(_TABLE_TAG), 0)
        between = F.transform(F.split(page, _TABLE_TAG, -1), F.char_length)

        def step(a, x):
            begin = a["at"] + x["gap"]
            end = begin + F.char_length(x["tag"])
            top = F.element_at(a["open"], -1)
            closed = F.struct(top.alias("start"), end.alias("stop"))
            closing, any_open = x["tag"].startswith("</"), F.size(a["open"]) > 0
            return F.struct(
                end.alias("at"),
                F.when(~closing, F.concat(a["open"], F.array(begin))).otherwise(F.slice(a["open"], 1, F.greatest(F.size(a["open"]) - 1, F.lit(0)))).alias("open"),
                F.when(closing & any_open, F.concat(a["done"], F.array(closed))).otherwise(a["done"]).alias("done"),
            )

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<start:int,stop:int>>").alias("done"))
        steps = F.zip_with(tags, F.slice(between, 1, F.size(tags)), lambda t, g: F.struct(t.alias("tag"), g.alias("gap")))
        spans = F.aggregate(steps, start, step, lambda a: F.array_sort(F.concat(a["done"], F.transform(a["open"], lambda o: F.struct(o.alias("start"), F.char_length(page).alias("stop"))))))
        return F.transform(spans, lambda s: F.substring(page, s["start"] + 1, s["stop"] - s["start"]))

    return let(F.coalesce(text, F.lit("")), cut)


def _numbered(dataset: str, number: Column) -> Column:
    """The dataset's name and a number of four digits or more."""
    text = number.cast("string")
    return F.concat(F.lit(dataset + "_"), F.lpad(text, F.greatest(F.length(text), F.lit(4)), F.lit("0")))


def page_pairs(pages: DataFrame, dataset: str, text_col: str = "value", path_col: str = "path") -> DataFrame:
    """The i-th image of a page with its i-th table, in order of suffix (html, htm, txt) and path, numbered over all pages. Paths are unique.

    Pages are placed by the counts of the pages before them (see amount_before), so no task holds all of them.
    """
    images = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(r"(?is)<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']+)[\"']"), 1), lambda s: s != "")
    rank = F.when(F.col(path_col).endswith(".html"), 0).when(F.col(path_col).endswith(".htm"), 1).otherwise(2)
    rows = pages.withColumn("__im", images).withColumn("__ta", table_elements(F.col(text_col))).withColumn("__pairs", zip_elements(F.col(text_col), F.col("__im"), F.col("__ta")))
    placed = amount_before(rows.select(rank.alias("__rank"), path_col, F.size("__pairs").alias("__n")), ["__rank", path_col], F.col("__n"), "__base")
    placed = placed.select(F.col(path_col).alias("__path"), "__base")
    out = rows.join(placed.hint("merge"), rows[path_col] == F.col("__path")).select(path_col, "__base", F.size("__im").alias("__ni"), F.size("__ta").alias("__nt"), F.posexplode("__pairs").alias("__i", "__pair"))
    meta = F.create_map(F.lit("source_file"), path_col, F.lit("source_index"), F.col("__i").cast("string"), F.lit("source_image_count"), F.col("__ni").cast("string"), F.lit("source_table_count"), F.col("__nt").cast("string"))
    sample_id = _numbered(dataset, F.col("__base") + F.col("__i"))
    return out.select(F.lit(dataset).alias("dataset"), sample_id.alias("sample_id"), F.col("__pair.left").alias("image"), F.concat(F.lit("<html><body>"), "__pair.right", F.lit("</body></html>")).alias("gt_html"), meta.alias("meta"))


def paired_samples(images: DataFrame, truths: DataFrame, dataset: str) -> DataFrame:
    """images: (path), truths: (path, value): images of known suffixes with the truth of the same stem, converted where it can be; the last path of a stem counts."""
    gt = truths.where(F.col("path").endswith(".html")).withColumn("stem", file_stem(F.col("path"))).groupBy("stem").agg(F.max_by("value", "path").alias("value"), F.max("path").alias("gt"))
    own = images.where(file_suffix(F.col("path")).isin(*IMAGE_SUFFIXES)).select(F.col("path").alias("image"), file_stem(F.col("path")).alias("stem"))
    rows = convert_responses(own.join(gt.hint("merge"), "stem"), "value", strip_notes=False)
    meta = F.create_map(F.lit("source_image"), "image", F.lit("source_gt"), "gt")
    return rows.select(F.lit(dataset).alias("dataset"), F.col("stem").alias("sample_id"), "image", F.when(F.col("conversion_ok"), F.col("html")).otherwise(F.col("value")).alias("gt_html"), meta.alias("meta"))


def item_samples(items: DataFrame, dataset: str) -> DataFrame:
    """items: (pos, item fields): the first filled table and image field of each; rows without either are left out. Items without an id are named by pos."""
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    rows = items.withColumn("__gt", first("gt_html", "html", "table_html")).withColumn("__image", first("image_data_uri", "image", "src")).drop("html")
    rows = convert_responses(rows, "__gt", strip_notes=False)
    gt = F.when(F.col("conversion_ok"), F.col("html")).otherwise(F.col("__gt"))
    sample_id = F.coalesce(F.nullif("id", F.lit("")), _numbered(dataset, F.col("pos")))
    kept = rows.where(F.col("__gt").isNotNull() & F.col("__image").isNotNull())
    meta = F.create_map(F.lit("source_index"), F.col("pos").cast("string"), F.lit("image_kind"), image_reference(F.col("__image"))["kind"])
    return kept.select(F.lit(dataset).alias("dataset"), sample_id.alias("sample_id"), F.col("__image").alias("image"), gt.alias("gt_html"), meta.alias("meta"))


def exploded_items(payloads: DataFrame, path_col: str = "path", body: str = "body") -> DataFrame:
    """(pos, item fields) of JSON payloads that are an array or an object with `items`; pos counts over all payloads, in order of their paths, which are unique."""
    fields = ",".join(f"{n}:{t}" for n, t in (x.split() for x in ITEM.split(", ")))
    items = F.coalesce(F.from_json(body, f"items array<struct<{fields}>>")["items"], F.from_json(body, f"array<struct<{fields}>>"))
    rows = payloads.select(F.col(path_col).alias("__path"), items.alias("__items"))
    placed = amount_before(rows.select("__path", F.coalesce(F.size("__items"), F.lit(0)).alias("__n")), ["__path"], F.greatest(F.col("__n"), F.lit(0)), "__base").select(F.col("__path").alias("__at"), "__base")
    joined = rows.join(placed.hint("merge"), rows["__path"] == F.col("__at"))
    return joined.select("__base", F.posexplode("__items").alias("__i", "item")).select((F.col("__base") + F.col("__i")).alias("pos"), "item.*")


def data_report(samples: DataFrame) -> DataFrame:
    """Per dataset: sample_count. The ids are the samples' own rows; no row gathers them."""
    return samples.groupBy("dataset").agg(F.count("*").alias("sample_count"))


def report_rows(samples: DataFrame) -> DataFrame:
    """(dataset, sample_count, sample_id): the report with its ids, an id a row."""
    return samples.select("dataset", "sample_id").join(few(data_report(samples)), "dataset").select("dataset", "sample_count", "sample_id")
