"""A tree as it was at a git reference, as files of a scan."""

from __future__ import annotations

import io
import subprocess
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.text import extension
from auditweave.sources.files import MAX_BYTES


def snapshot(spark: SparkSession, repository: str, reference: str, subtree: str = "") -> DataFrame:
    """file, dir, ext, text, size_bytes of a subtree at a reference, ``scan_id`` baseline. A subtree that was not there gives no rows.

    git runs on the driver, where the repository is; a repository's tree is what one machine checks out. The reference is
    resolved to a commit first, links and paths that leave the tree are not taken."""
    commit = subprocess.run(["git", "-C", repository, "rev-parse", "--verify", "--end-of-options", f"{reference}^{{commit}}"], capture_output=True, check=True, text=True, timeout=60).stdout.strip()
    there = not subtree or subprocess.run(["git", "-C", repository, "cat-file", "-e", f"{commit}:{subtree}"], capture_output=True, timeout=60, check=False).returncode == 0
    rows = []
    if there:
        packed = subprocess.run(["git", "-C", repository, "archive", "--format=tar", commit, *([subtree] if subtree else [])], capture_output=True, check=True, timeout=600).stdout
        with tarfile.open(fileobj=io.BytesIO(packed)) as tar:
            for m in tar:
                if m.isfile() and m.size <= MAX_BYTES and not m.name.startswith("/") and ".." not in m.name.split("/"):
                    rows.append((m.name, tar.extractfile(m).read().decode("utf-8", "replace"), m.size))
    files = spark.createDataFrame(rows, "file string, text string, size_bytes long")
    return files.select(F.lit("baseline").alias("scan_id"), "file", F.regexp_replace("file", r"/?[^/]*$", "").alias("dir"), extension(F.col("file")).alias("ext"), "text", "size_bytes")
