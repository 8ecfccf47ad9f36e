"""Files against manifests, paths, links and publication rules. A file table has rows (path, content or bytes and sha256)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import has_secret, is_digest, markdown_links

# Fixed values of the publication rules.
IGNORED = (".git", ".venv", "__pycache__", ".pytest_cache", "generated")
PRIVATE_TREES = ("api", "ocr_engine", "pipeline", "services", "deploy", "model_zoo", "uploads")
MODEL_SUFFIXES = ("onnx", "safetensors", "pth", "pt", "pdparams", "pdiparams", "pkl")
TEXT_SUFFIXES = ("md", "py", "json", "jsonl", "txt", "yml", "yaml", "example")
LARGEST = 10 * 1024 * 1024
SCHEMES = ("https", "http", "mailto")


def identities(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of rows (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def unlisted(actual: DataFrame, manifest: DataFrame, own: str = "") -> DataFrame:
    """Paths that are there but not on the list (nor the list itself)."""
    return actual.filter(F.col("path") != own).select("path").join(manifest.select("path"), "path", "left_anti")


def missing(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    return manifest.select("path").join(actual.select("path"), "path", "left_anti")


def changed(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, expected and actual identity) of files that are there but differ."""
    a = actual.select("path", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("actual_sha256"))
    both = manifest.select("path", "bytes", "sha256").join(a, "path")
    return both.filter(~(F.col("bytes").eqNullSafe(F.col("actual_bytes")) & F.col("sha256").eqNullSafe(F.col("actual_sha256"))))


def file_checks(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(check_id, passed, error) of each manifest row: identity well formed, file there, bytes and digest equal."""
    a = actual.select("path", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("actual_sha256"), F.lit(True).alias("there"))
    both = manifest.join(a, "path", "left")
    error = (
        F.when(~path_ok(F.col("path")), "evidence path must stay inside the package")
        .when(F.col("bytes").isNull(), "recorded byte count must be an integer")
        .when(F.col("bytes") < 0, "invalid file identity")
        .when(~is_digest(F.col("sha256")), "expected a lowercase sha-256 digest")
        .when(F.col("there").isNull(), "missing evidence file")
        .when((F.col("bytes") != F.col("actual_bytes")) | (F.col("sha256") != F.col("actual_sha256")), "recorded bytes/hash differ")
    )
    return both.select(F.concat(F.lit("file_hash:"), "path").alias("check_id"), error.isNull().alias("passed"), error.alias("error"))


def provenance_mismatches(provenance: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows (path, sha256) whose file is there with another digest; absent files are skipped."""
    return provenance.select("path", "sha256").join(actual.select("path", F.col("sha256").alias("actual_sha256")), "path").filter(F.col("sha256") != F.col("actual_sha256"))


def same_sets(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """One row (same): whether both have the same distinct keys."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    return left.join(right, list(keys), "full_outer").agg(F.coalesce(F.bool_and(F.col("__a").isNotNull() & F.col("__b").isNotNull()), F.lit(True)).alias("same"))


def path_ok(path: Column, canonical: bool = True) -> Column:
    """A relative POSIX path that stays below its root; canonical ones have no empty and no "." parts."""
    parts = F.split(path, "/", -1)
    ok = (path != "") & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit(":")) & ~path.startswith("/") & ~F.array_contains(parts, "..")
    if canonical:
        ok = ok & ((path == ".") | (~F.array_contains(parts, "") & ~F.array_contains(parts, ".")))
    return F.coalesce(ok, F.lit(False))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^/.]+)\z", 1))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def in_ignored_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))


def publication_errors(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, error), one row for each rule a listed file breaks. files: path, content; manifest: path, bytes, sha256."""
    actual = identities(files).withColumnsRenamed({"bytes": "actual_bytes", "sha256": "actual_sha256"})
    rows = manifest.join(files.join(actual, "path"), "path", "left")
    path, good = F.col("path"), path_ok(F.col("path"), False)
    there = good & F.col("content").isNotNull()
    texty = there & (suffix(path).isin(*TEXT_SUFFIXES) | name_of(path).startswith("."))
    whole = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(texty & whole, F.col("content").cast("string"))
    hidden = name_of(path).startswith(".env") & (name_of(path) != ".env.example")
    rules = [
        (~good, "invalid public relative path"),
        (good & (F.get(F.split(path, "/"), F.lit(0)).isin(*PRIVATE_TREES) | suffix(path).isin(*MODEL_SUFFIXES)), "outside selected-code publication scope"),
        (good & hidden, "runtime environment files are private"),
        (good & ~there, "missing"),
        (there & ~(F.col("bytes").eqNullSafe(F.col("actual_bytes")) & F.col("sha256").eqNullSafe(F.col("actual_sha256"))), "bytes/hash differ from the reviewed file"),
        (there & (F.col("actual_bytes") > LARGEST), "exceeds the file size limit"),
        (texty & text.isNull(), "expected UTF-8 text"),
        (has_secret(text), "credential-shaped content; inspect privately"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(e)) for c, e in rules]))
    return rows.select("path", F.explode(found).alias("error"))


def resolved(folder: Column, target: Column) -> Column:
    """target against a folder, with "." and ".." taken out; null if it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(target.startswith("/"), F.lit("..")).otherwise(folder), target), "/"), lambda p: ~p.isin("", "."))
    walk = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok")), lambda s, p: F.struct(
        F.when(p == "..", F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(F.concat(s["at"], F.array(p))).alias("at"),
        (s["ok"] & ~((p == "..") & (F.size(s["at"]) == 0))).alias("ok"),
    ))
    return F.when(walk["ok"], F.array_join(walk["at"], "/"))


def link_errors(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, target, error) of Markdown pages (path, text): links of unknown schemes, and relative ones that lead to no existing path or folder."""
    links = pages.select("path", F.explode(markdown_links("text")).alias("target"))
    scheme = F.lower(F.regexp_extract("target", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    links = links.withColumn("scheme", scheme).withColumn("remote", (scheme != "") | F.col("target").startswith("//"))
    odd = links.filter(F.col("remote") & ~F.col("scheme").isin(*SCHEMES)).select("path", "target", F.lit("unsupported/non-public link").alias("error"))
    plain = F.try_url_decode(F.regexp_extract("target", r"^([^?#]*)", 1))
    near = links.filter(~F.col("remote")).withColumn("to", plain).filter("to <> ''")
    near = near.withColumn("at", resolved(F.regexp_extract("path", r"^(.*)/[^/]*\z", 1), F.col("to")))
    folders = existing.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("at"))
    known = existing.select(F.col("path").alias("at")).unionByName(folders).distinct()
    dead = near.join(known, "at", "left_anti").select("path", "target", F.lit("missing or private relative link").alias("error"))
    return odd.unionByName(dead)


def publication_report(errors: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row: passed, reviewed_files, total_bytes (of listed files that are there), errors."""
    sizes = identities(files).select("path", F.col("bytes").alias("b"))
    totals = manifest.select("path").join(sizes, "path", "left").agg(F.count(F.lit(1)).alias("reviewed_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"))
    listed = errors.agg(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "error"))).alias("errors"))
    return totals.crossJoin(listed).select((F.size("errors") == 0).alias("passed"), "reviewed_files", "total_bytes", "errors")
