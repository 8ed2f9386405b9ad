"""Frequency of every distinct term: recursive radix spilling with DuckDB.

Each map task counts its own records in DuckDB, so a term that holds a third of all occurrences leaves it as one row. The
counts are sent by the leading bits of the term's hash. A reducing task that receives more rows than it may hold writes
them to files by the next bits, splits files that are still too large by the bits after those, and aggregates each file
in DuckDB under a memory limit, with DuckDB's own spilling for what no bits can split.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Rows, and bytes of them, that a task holds before it writes them to files.
HELD_ROWS, HELD_BYTES = 400_000, 128_000_000
RADIX_BITS, SPLIT_BITS, MEMORY = 12, 4, "256MB"
COUNTED = "bits int, field string, term string, hash bigint, n_occurrences bigint, n_records bigint"
_MERGE = "select field, term, any_value(hash) hash, sum(n_occurrences)::bigint n_occurrences, sum(n_records)::bigint n_records from part group by field, term"


def _connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
    return con


def _scratch(shared: str) -> str:
    """A folder of this task's own: in the shared folder where that is a mounted path, else where Spark spills."""
    base = shared[len("file:") :].replace("///", "/", 1) if shared.startswith("file:") else os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or "."
    return os.path.join("/" + base.lstrip("/") if base.startswith("/") else base, f"terms-{uuid.uuid4().hex}")


def _count(shared: str, held: int, held_bytes: int):
    """Map side: records of one task to (term, occurrences, records), merged across batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _scratch(shared)
        con = _connect(folder)
        con.execute("create table acc (field varchar, term varchar, n_occurrences bigint, n_records bigint)").fetchall()
        out = f"select (hash(term) >> {64 - RADIX_BITS})::int bits, field, term, (hash(term) // 2)::bigint hash, sum(n_occurrences)::bigint n_occurrences, sum(n_records)::bigint n_records from acc group by field, term"
        size = 0
        try:
            for batch in batches:
                part = pa.table({"field": batch.column(0), "terms": batch.column(1)})  # noqa: F841
                con.execute("""insert into acc select field, term, sum(n), count(*) from (
                    select r, field, term, count(*) n from (select row_number() over () r, field, unnest(terms) term from part)
                    where term is not null group by r, field, term) group by field, term""").fetchall()
                size += batch.nbytes
                if size > held_bytes or con.execute("select count(*) from acc").fetchall()[0][0] > held:
                    yield from con.sql(out).to_arrow_table().to_batches(50_000)
                    con.execute("delete from acc").fetchall()
                    size = 0
            yield from con.sql(out).to_arrow_table().to_batches(50_000)
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _radix(shared: str, held: int, held_bytes: int):
    """Reduce side: one task's rows aggregated, through files split by further bits where there are too many."""

    def merged(con: duckdb.DuckDBPyConnection, part: pa.Table) -> Iterator[pa.RecordBatch]:
        done = con.sql(_MERGE).to_arrow_table()
        yield from done.select(["field", "term", "n_occurrences", "n_records"]).to_batches(50_000)

    def split(batches: Iterator[pa.RecordBatch], folder: str, depth: int) -> list[tuple[str, int, int]]:
        """Rows written to a file per value of the bits at this depth: (file, rows, bytes) of each."""
        files: dict[int, tuple[pa.RecordBatchFileWriter, str]] = {}
        rows: dict[int, int] = {}
        size: dict[int, int] = {}
        shift = 63 - RADIX_BITS - SPLIT_BITS * (depth + 1)
        try:
            for b in batches:
                t = pa.Table.from_batches([b])
                digit = (t.column("hash").to_numpy() >> shift) & ((1 << SPLIT_BITS) - 1)
                for k in set(digit.tolist()):
                    chosen = t.filter(pa.array(digit == k))
                    if k not in files:
                        path = os.path.join(folder, f"{depth}-{uuid.uuid4().hex}.arrow")
                        files[k] = pa.ipc.new_file(path, t.schema), path
                    files[k][0].write_table(chosen)
                    rows[k] = rows.get(k, 0) + len(chosen)
                    size[k] = size.get(k, 0) + chosen.nbytes
        finally:
            for w, _ in files.values():
                w.close()
        return [(path, rows[k], size[k]) for k, (_, path) in files.items()]

    def read(path: str) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(path) as f:
            r = pa.ipc.open_file(f)
            for i in range(r.num_record_batches):
                yield r.get_batch(i)

    def spilled(con: duckdb.DuckDBPyConnection, batches: Iterator[pa.RecordBatch], folder: str, depth: int) -> Iterator[pa.RecordBatch]:
        for path, n, size in split(batches, folder, depth):
            if (n <= held and size <= held_bytes) or 63 - RADIX_BITS - SPLIT_BITS * (depth + 2) < 0:  # fits, or no bits are left: DuckDB spills
                part = pa.Table.from_batches(list(read(path)))
                yield from merged(con, part)
            else:
                yield from spilled(con, read(path), folder, depth + 1)
            os.remove(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _scratch(shared)
        con = _connect(folder)
        kept, n, size = [], 0, 0

        def all_batches() -> Iterator[pa.RecordBatch]:
            while kept:
                yield kept.pop(0)
            yield from batches

        try:
            for b in batches:
                kept.append(b)
                n += len(b)
                size += b.nbytes
                if n > held or size > held_bytes:
                    os.makedirs(folder, exist_ok=True)
                    yield from spilled(con, all_batches(), folder, 0)
                    return
            if kept:
                part = pa.Table.from_batches(kept)
                yield from merged(con, part)
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)

    return run


def term_counts(records: DataFrame, held_rows: int = HELD_ROWS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``field, term, n_occurrences, n_records`` of records ``field string, terms array<string>``, one row per record.

    Terms are compared exactly, the empty string is a term, null terms and null arrays are none; a null field is a field
    of its own. Further columns are ignored. An empty table gives no rows.
    """
    shared = shared_dir(records.sparkSession)
    sent = records.select(F.col("field").cast("string"), "terms").mapInArrow(_count(shared, held_rows, held_bytes), COUNTED).repartition("bits")
    return sent.mapInArrow(_radix(shared, held_rows, held_bytes), "field string, term string, n_occurrences bigint, n_records bigint")


def marked(counts: DataFrame, totals: dict[str, int], rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` below so many records, ``common`` above that share of the field's records, else null."""
    common = F.lit(False)
    for field, n in totals.items():
        common = common | ((F.col("field") == field) & (F.col("n_records") > common_share * n))
    return counts.withColumn("mark", F.when(F.col("n_records") < rare_below, "rare").when(common, "common"))
