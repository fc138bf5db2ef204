"""Secret scan with corpus-wide ownership frequency.

A first pass finds candidates in every text: three base patterns and high-entropy
strings. Their hashes are then counted by distinct owners and distinct repositories.
A string that many owners hold is a widely copied example, and so is one that is spread
over most repositories of an owner who has several: a template that its projects share.
One that a single owner holds in few of its repositories looks live. Base spans always
stay; a high-entropy string becomes a span of its own unless it is widely copied.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import salted_join
from .storage import saved

KINDS = ("assign", "access", "hex", "entropy")
_WORDS = "password passwd secret token api_?key".split()
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
_ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORD = re.compile(_EITHER)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DENSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits a character from which a string counts as random; owners from which it counts as copied.
LEAST_ENTROPY, COPIED_OWNERS = 3.5, 3
#: Repositories from which it counts as copied within one owner, and the share of all the
#: owner's repositories that these must be.
COPIED_REPOSITORIES, COPIED_SHARE = 3, 0.6
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary())])


def entropy(value: str) -> float:
    """Shannon entropy of a string's characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of the base patterns, in code points; by kind leftmost
    and not overlapping, with the length rules applied to whole matches afterwards."""
    found = []
    if _KEYWORD.search(text):
        found += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def dense_spans(text: str, base: list[tuple]) -> list[tuple[int, int, int, str]]:
    """High-entropy strings of letters of both cases and digits outside the base spans."""
    found = []
    for m in _DENSE.finditer(text):
        value = m[0]
        mixed = any(c.isdigit() for c in value) and value.upper() != value and value.lower() != value
        if mixed and entropy(value) >= LEAST_ENTROPY and not any(a < m.end() and m.start() < b for _, a, b, _ in base):
            found.append((3, m.start(), m.end(), value))
    return found


def _candidates(batches):
    names = ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "found"]
    for batch in batches:
        counts, digests, spans = [[], [], []], [], []
        for text in batch.column(3).to_pylist():
            text = text or ""
            base = base_spans(text)
            for k in range(3):
                counts[k].append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in base).encode()).hexdigest())
            spans.append([{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(v.encode()).digest()[:16]} for k, a, b, v in base + dense_spans(text, base)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans, pa.list_(_SPAN))], names=names)


def find_secrets(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans
    ("kind:start:end" by start, then kind, comma-joined), n_live and n_copied (spans whose
    string one owner holds and isn't copied, and whose string is copied), span_owners and
    span_repositories (of each span's string, in the order of ``spans``). A string is
    copied if COPIED_OWNERS or more owners hold it, or one owner alone in COPIED_REPOSITORIES
    or more repositories that are COPIED_SHARE or more of all its own.

    A null or empty text has no spans: counts 0, spans "", the digest of "". A null owner
    or repository counts as one of its own. Repeated rows each get a row; they don't
    raise the counts, which are of distinct owners and repositories. Secrets themselves
    are never output, only positions."""
    spark_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("(null)")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("(null)")).alias("repository"), F.col(text_col).alias("text"))
    schema = "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:long,end:long,hash:binary>>"
    rows = saved(spark_rows.mapInArrow(_candidates, schema).withColumn("row", F.monotonically_increasing_id()), "secrets")
    spans = rows.select("row", "owner", "repository", F.explode("found").alias("s")).select("row", "owner", "repository", "s.*")
    # an owner's repositories, with and without candidates
    owned = rows.select("owner", "repository").distinct().groupBy("owner").agg(F.count("*").alias("owned"))
    # one row for each (string, owner) first: copies within one don't pile up on a hash
    held = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    held = held.join(owned, "owner").groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("owned").alias("owned"))
    spread = (F.col("owners") == 1) & (F.col("repositories") >= COPIED_REPOSITORIES) & (F.col("repositories") >= F.col("owned") * F.lit(COPIED_SHARE))
    held = held.select("hash", "owners", "repositories", ((F.col("owners") >= COPIED_OWNERS) | spread).alias("copied"))
    # a widely copied string's rows are dealt to several tasks
    judged = salted_join(spans.select("row", "kind", "start", "end", "hash"), held, "hash").where("kind < 3 OR NOT copied")
    kinds = F.array(*(F.lit(k) for k in KINDS))
    listed = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories"))).alias("s"), F.sum(F.expr("owners = 1 AND NOT copied").cast("long")).alias("n_live"), F.sum(F.col("copied").cast("long")).alias("n_copied"))
    text = F.array_join(F.transform("s", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    listed = listed.select("row", text.alias("spans"), "n_live", "n_copied", F.col("s.owners").alias("span_owners"), F.col("s.repositories").alias("span_repositories"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = lambda c: F.coalesce(c, F.array().cast("array<bigint>")).alias(c)
    return rows.join(listed, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"), none("span_owners"), none("span_repositories"))
