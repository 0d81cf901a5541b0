"""Git repositories on a path that executors share: the tree of a ref, and blobs."""

from __future__ import annotations

import fnmatch
import subprocess
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import scan
from lodestone.sources.registry import Ref, guess_type

MAX_BYTES = 1_000_000


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


def _blobs(repo: str, hashes: list[str]) -> Iterator[bytes | None]:
    """The contents of blobs by one process; None for one that isn't there."""
    if not hashes:
        return
    names = "".join(h + "\n" for h in hashes).encode()
    raw = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "cat-file", "--batch"], input=names, check=True, capture_output=True).stdout
    at = 0
    for _ in hashes:
        end = raw.index(b"\n", at)
        head = raw[at:end].split()
        at = end + 1
        if head[-1] == b"missing":
            yield None
        else:
            size = int(head[2])
            yield raw[at : at + size]
            at += size + 1


class GitConnector:
    def __init__(self, repo: str, ref: str = "HEAD", include: Sequence[str] = ("*",), exclude: Sequence[str] = (), max_file_size_bytes: int = MAX_BYTES):
        if ref.startswith("-"):
            raise ValueError("a ref can't start with a dash")
        self.repo, self.ref, self.include, self.exclude, self.most = repo, ref, include, exclude, max_file_size_bytes

    def validate(self, spark: SparkSession) -> None:
        _git(self.repo, "rev-parse", "--verify", self.ref)

    def now(self) -> datetime:
        return datetime.now(UTC)

    def slices(self) -> list[str]:
        """What the ref has at its top: directories, as ``name/``, and all single files together, as ''."""
        entries = [x.partition("\t") for x in _git(self.repo, "ls-tree", "-z", self.ref).decode(errors="replace").split("\0") if x]
        trees = [path + "/" for head, _, path in entries if head.split()[1] == "tree"]
        return trees + [""] * any(head.split()[1] == "blob" for head, _, _ in entries)

    def listed(self, slice: str, since: datetime | None = None, until: datetime | None = None) -> Iterator[Ref]:
        """Blobs below a directory (or at the top): the path is the id, the blob's hash the version. A tree knows no times of
        change, so ``since`` and ``until`` are the scan's to refuse."""
        tree = ("-r", "-z", "-l", "--full-tree", self.ref, "--", slice) if slice else ("-z", "-l", self.ref)
        for line in _git(self.repo, "ls-tree", *tree).decode(errors="replace").split("\0"):
            head, _, path = line.partition("\t")
            if not path or head.split()[1] != "blob":
                continue
            sha, size = head.split()[2:4]
            if any(fnmatch.fnmatch(path, p) for p in self.include) and not any(fnmatch.fnmatch(path, p) for p in self.exclude):
                yield Ref(path, f"git+{self.repo}#{self.ref}:{path}", None, {"blob": sha, "size": size, "content_type": guess_type(path)})

    def discover(self, spark: SparkSession) -> DataFrame:
        """All refs (REF), each directory at the top listed by a task."""
        return scan.read(spark, self).drop("slice")

    def fetch(self, spark: SparkSession, refs: DataFrame) -> DataFrame:
        """Blobs that aren't larger than the limit, nor binary (a NUL in the first 8192 bytes)."""
        repo, most = self.repo, self.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = [(r, m) for r in batch.to_pylist() if int((m := dict(r["metadata"])).get("size", 0)) <= most]
                rows = [(r["external_id"], r["uri"], m["content_type"], c) for (r, m), c in zip(asked, _blobs(repo, [m["blob"] for _, m in asked])) if c is not None and b"\0" not in c[:8192]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["external_id", "uri", "content_type", "content"])

        return refs.mapInArrow(run, "external_id string, uri string, content_type string, content binary")
