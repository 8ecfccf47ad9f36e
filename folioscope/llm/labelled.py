"""Labels of documents for the classifiers, whole or as bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_labels(labels: DataFrame, label: str, train: Column) -> DataFrame:
    """(__id, __label) of the training rows. A doc_id with several label rows has the largest of them; null labels do not count."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__label")).filter(F.col("__label").isNotNull() & F.col("__id").isNotNull())
    return known.groupBy("__id").agg(F.max("__label").alias("__label")).filter(train)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, longest: int | None = None) -> DataFrame:
    """docs (doc_id, text) with __label, of at most so many training rows of each class, by the least hash of doc_id.

    The sample's bound makes its broadcast safe, and texts are not shuffled. Texts of more than longest bytes are not learned from.
    """
    known = known_labels(labels, label, train)
    order = [F.xxhash64("__id"), F.col("__id")]
    few = known.filter("__label = 1").orderBy(*order).limit(most).unionByName(known.filter("__label = 0").orderBy(*order).limit(most))
    if longest is not None:
        docs = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    return docs.join(F.broadcast(few), docs["doc_id"].cast("long") == few["__id"]).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), "__label")
