"""Incremental scans: what must be read again when some files of a tree have changed.

A file's findings depend on its own text and, through data flow, on the files it imports and on those that import it (a
value may come from a caller as well as from a callee). So the files to read again are those that are new, gone or of
another digest, and all that are connected with them by import edges of the tree before or after. The closure is semi-naive:
a round joins only the files that the round before added. Findings of all other files are taken over as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.operators.flow import flow_facts
from auditweave.operators.imports import checkpointed


def digests(files: DataFrame) -> DataFrame:
    """(file, digest) of each file's content; a null text has a digest of its own."""
    return files.select("file", F.coalesce(F.sha2("text", 256), F.lit("null")).alias("digest"))


def import_edges(files: DataFrame) -> DataFrame:
    """(importer, imported): each import of the tree, resolved to the first of its candidates that is there."""
    tried = flow_facts(files).filter("what = 'import'").select(F.col("file").alias("importer"), "names").distinct()
    tried = tried.select("importer", "names", F.posexplode("names").alias("ord", "file")).join(files.select("file").distinct(), "file", "left_semi")
    return tried.groupBy("importer", "names").agg(F.min_by("file", "ord").alias("imported")).select("importer", "imported").distinct()


def stale(now: DataFrame, before: DataFrame, edges: DataFrame) -> DataFrame:
    """now, before: (file, digest) of the trees; edges: imports of both. (file, reason): changed, new or gone, or depends on such a file."""
    both = now.select("file", F.col("digest").alias("_now")).join(before.select("file", F.col("digest").alias("_before")), "file", "full")
    why = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_before"), "changed")
    known = delta = checkpointed(both.select("file", why.alias("reason")).filter("reason is not null"))
    near = checkpointed(edges.select(F.col("importer").alias("file"), F.col("imported").alias("_to")).union(edges.select("imported", "importer")).distinct())
    while True:
        more = delta.join(near, "file").select(F.col("_to").alias("file")).distinct().join(known, "file", "left_anti")
        delta = checkpointed(more.select("file", F.lit("depends").alias("reason")))
        if delta.limit(1).count() == 0:
            return known
        known = checkpointed(known.union(delta))


def rescanned(files: DataFrame, before: DataFrame, edges_before: DataFrame, findings_before: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The findings of files: those before for the files that nothing touched, those of scan (a function of files) for the rest."""
    again = stale(digests(files), before, edges_before.union(import_edges(files)).distinct())
    found = scan(files.join(again.select("file"), "file", "left_semi"))
    return findings_before.join(again.select("file"), "file", "left_anti").select(found.columns).unionByName(found)
