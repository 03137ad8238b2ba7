"""A stream of inserts, updates and deletes applied to a table, whatever was repeated or out of order.

The state of a key is the maximum of (sequence, operation, payload) over its base row and all its changes.
The maximum is commutative, associative and idempotent, so order and repetition of deliveries cannot matter.
Deletes stay in the state as tombstones, so that an older change arriving later cannot revive a row.

Defined cases: operations are read without regard to letter case and surrounding blanks; an update of a
missing row creates it; a change whose operation is none of create, update, delete, or whose sequence is
null, is not applied; null key parts are values like any other; at an equal sequence the greater operation
name, then the greater payload wins; empty inputs give empty states; payload columns may have any name but
those of the keys. A hot key is folded before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPLIED = ("create", "update", "delete")


def _entry(sequence: Column, operation: Column, payload: Sequence[str]) -> Column:
    fields = [sequence.alias("seq"), F.lower(F.trim(operation)).alias("op")]
    return F.struct(*fields, F.struct(*[F.col(c) for c in payload]).alias("row")) if payload else F.struct(*fields)


def fold_changes(
    changes: DataFrame, keys: Sequence[str], sequence: str, operation: str, payload: Sequence[str] = (), base: DataFrame | None = None
) -> DataFrame:
    """State (*keys, __state struct(seq, op, row)) of a base table and its changes, tombstones included.

    base: an earlier state, or None. Folding the state of one delivery into the next gives the state of both.
    """
    op = F.lower(F.trim(F.col(operation)))
    entries = changes.filter(op.isin(*APPLIED) & F.col(sequence).isNotNull()).select(
        *keys, _entry(F.col(sequence), F.col(operation), payload).alias("__state")
    )
    if base is not None:
        entries = entries.unionByName(base.select(*keys, "__state"))
    return entries.groupBy(*keys).agg(F.max("__state").alias("__state"))


def live_rows(state: DataFrame, keys: Sequence[str], sequence: str, payload: Sequence[str] = ()) -> DataFrame:
    """The rows that exist: *keys, the sequence of the change that gave their content, and the payload."""
    rows = state.filter(F.col("__state.op") != "delete")
    return rows.select(*keys, F.col("__state.seq").alias(sequence), *[F.col(f"__state.row.{c}").alias(c) for c in payload])


REPO_KEYS = ("did", "collection", "rkey")


def repo_changes(firehose: DataFrame) -> DataFrame:
    """One row per commit of the firehose: keys, rev, operation and the record."""
    return firehose.filter(F.col("kind") == "commit").select(
        "did",
        F.col("commit.collection").alias("collection"),
        F.col("commit.rkey").alias("rkey"),
        F.col("commit.rev").alias("rev"),
        F.col("commit.operation").alias("operation"),
        F.col("commit.record").alias("record"),
    )


def repo_records(firehose: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(did, collection, rkey, rev, record) of every record that exists after all commits took effect."""
    state = fold_changes(repo_changes(firehose), REPO_KEYS, "rev", "operation", ["record"], base)
    return live_rows(state, REPO_KEYS, "rev", ["record"])
