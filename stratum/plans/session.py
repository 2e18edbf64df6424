"""Sessions: statements against a catalog and three namespaces of handles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FAILURES, StatementError, message
from ..operators import dml, vectors
from ..operators.batch import Batch
from ..sources import storage
from ..sources.catalog import Catalog, Table, valid_name
from . import dsl
from .frame import Frame, NumVal, PosVec, ValVec, base_frame, evaluate

MOST_PRINTED = 64
#: Inserted rows of a table that wait for a read before they are written anyway.
MOST_WAITING = 100_000


class Session:
    """One client. Handles stay symbolic; only printing and data changes run jobs.

    `run` answers one statement with its lines of output; whatever fails, also in a job,
    is a line. `script` runs many and
    evaluates all numbers that they print together, one job per frame or batch.
    """

    def __init__(self, spark: SparkSession, root: str | Catalog):
        self.spark = spark
        self.catalog = root if isinstance(root, Catalog) else Catalog(root)
        self.positions: dict[str, PosVec] = {}
        self.values: dict[str, ValVec] = {}
        self.numbers: dict[str, NumVal] = {}
        self.batch: Batch | None = None
        self.single = False
        self.closed = False
        self._frames: dict[tuple[str, int], Frame] = {}

    # names

    def flush(self, table: Table) -> None:
        """Write the rows inserted since the table was last read or changed."""
        dml.insert(self.catalog, self.spark, table)

    def flush_all(self) -> None:
        for name in list(self.catalog.pending):
            self.flush(self.catalog.tables[name])

    def frame(self, table: Table) -> Frame:
        """The shared frame of a table's current version."""
        self.flush(table)
        key = table.name, table.number
        if key not in self._frames:
            f = base_frame(table.name, table.number, storage.read_version(self.spark, table), table.version.rows, storage.without_positions(self.spark, table))
            prefix = f.sources[0].prefix
            for column, path in table.version.indexes.items():
                side = self.spark.read.schema(f"`{column}` int, {storage.POS} long").parquet(path)
                f.indexes[prefix + column] = side.select(*(F.col(c).alias(prefix + c) for c in side.columns))
            self._frames[key] = f
        return self._frames[key]

    def value(self, name: str) -> ValVec:
        if name in self.values:
            return self.values[name]
        if name.count(".") != 2:
            raise StatementError(f"Value vector {name} does not exist.")
        table, column = self.catalog.column(name)
        table.complete()
        f = self.frame(table)
        c = f.sources[0].column(column)
        return ValVec(f, F.col(c), frozenset([c]), (table.name, column))

    def position(self, name: str) -> PosVec:
        if name not in self.positions:
            raise StatementError(f"Position vector {name} does not exist.")
        return self.positions[name]

    # statements

    def run(self, line: str) -> list[str]:
        """The output of one statement; errors are a line of output."""
        return list(self.script([line]))

    def script(self, lines: Iterable[str]) -> Iterator[str]:
        pending: list[str | list[NumVal]] = []
        for line in lines:
            try:
                s = dsl.parse(line)
                if s is not None:
                    pending += self._run(s)
            except StatementError as e:
                pending.append(str(e))
            except FAILURES as e:  # the statement failed, the session goes on
                pending.append(message(e))
            if self.closed:
                break
        evaluate([v for p in pending if isinstance(p, list) for v in p])
        for p in pending:
            if isinstance(p, list):
                errors = [v.error for v in p if v.error is not None]
                yield errors[0] if errors else ",".join(_format(v) for v in p)
            else:
                yield p

    def _run(self, s: dsl.Statement) -> list[str | list[NumVal]]:
        if self.batch is not None and s.command not in ("select", "min", "max", "sum", "avg", "batch_queries", "batch_execute", "shutdown"):
            raise StatementError("Unbatchable command type.")
        return getattr(self, f"_do_{s.command}")(s) or []

    def _do_shutdown(self, s: dsl.Statement) -> None:
        self.close()

    def close(self) -> None:
        """Write everything and forget the handles."""
        self.flush_all()
        self.catalog.save()
        self.positions, self.values, self.numbers, self.batch = {}, {}, {}, None
        self.closed = True

    def _do_create(self, s: dsl.Statement) -> None:
        kind, args = s.args[0], s.args[1:]
        if kind == "db" and len(args) == 1:
            self._frames = {}
            self.catalog.create_db(dsl.quoted(args[0]))
        elif kind == "tbl" and len(args) == 3:
            self.catalog.create_table(args[1], dsl.quoted(args[0]), dsl.number(args[2]))
        elif kind == "col" and len(args) == 2:
            self.catalog.create_column(self.catalog.table(args[1]), dsl.quoted(args[0]))
        elif kind == "idx" and len(args) == 3:
            self.create_index(*args)
        else:
            raise StatementError("Invalid command.")

    def create_index(self, variable: str, structure: str, layout: str) -> None:
        """clustered: the rows are kept sorted; unclustered: a sorted projection is kept beside them."""
        if structure not in ("btree", "sorted") or layout not in ("clustered", "unclustered"):
            raise StatementError("Unknown kind of index.")
        table, column = self.catalog.column(variable)
        self.flush(table)
        clustered = layout == "clustered"
        if column in table.index:
            raise StatementError(f"Column {column} already has an index.")
        if clustered and table.clustered:
            raise StatementError(f"Table {table.name} already has a clustered index.")
        table.index[column] = structure, clustered
        try:
            if table.filled and (clustered or table.external):
                storage.rewrite(self.catalog, table, storage.read_version(self.spark, table))
            elif table.filled:
                storage.publish(self.catalog, self.spark, table, table.version.segments)
        except Exception:
            del table.index[column]
            raise
        self.catalog.save()

    def _do_load(self, s: dsl.Statement) -> None:
        self.flush_all()
        storage.load_csv(self.catalog, self.spark, dsl.quoted(s.args[0]))

    def register(self, name: str, df: DataFrame) -> None:
        """Integer columns of a DataFrame as a table of the database."""
        storage.register(self.catalog, valid_name(name), df)

    def attach(self, name: str, path: str, columns: list[str]) -> None:
        """Integer columns of a parquet file as a table, read in place."""
        storage.attach(self.catalog, self.spark, valid_name(name), path, columns)

    def _one(self, s: dsl.Statement) -> str | None:
        if len(s.handles) > 1:
            raise StatementError("One output handle required.")
        return s.handles[0] if s.handles else None

    def _do_select(self, s: dsl.Statement) -> None:
        handle = self._one(s)
        within = self.position(s.args[0]) if len(s.args) == 4 else None
        vector = self.value(s.args[-3])
        low, high = dsl.bound(s.args[-2]), dsl.bound(s.args[-1])
        if self.batch is not None:
            self.batch.add_select(handle, vector, low, high, within)
        elif handle:
            self.positions[handle] = vectors.select(vector, low, high, within)

    def _do_fetch(self, s: dsl.Statement) -> None:
        handle = self._one(s)
        vector, p = self.value(s.args[0]), self.position(s.args[1])
        if handle:
            self.values[handle] = vectors.fetch(vector, p)

    def _arithmetic(self, s: dsl.Statement) -> None:
        handle = self._one(s)
        a, b = self.value(s.args[0]), self.value(s.args[1])
        if handle:
            self.values[handle] = vectors.arithmetic(s.command, a, b)

    _do_add = _do_sub = _arithmetic

    def _aggregate(self, s: dsl.Statement) -> None:
        handle = self._one(s)
        vector = self.value(s.args[0])
        if self.batch is not None:
            self.batch.add_aggregate(handle, s.command, vector)
        elif handle:
            self.numbers[handle] = vectors.aggregate(s.command, vector)
            self.numbers[handle].single = self.single

    _do_min = _do_max = _do_sum = _do_avg = _aggregate

    def _do_join(self, s: dsl.Statement) -> None:
        if len(s.handles) != 2:
            raise StatementError("Two output handles required.")
        v1, p1, v2, p2 = self.value(s.args[0]), self.position(s.args[1]), self.value(s.args[2]), self.position(s.args[3])
        self.positions[s.handles[0]], self.positions[s.handles[1]] = vectors.join(v1, p1, v2, p2, s.args[4])

    def _do_print(self, s: dsl.Statement) -> list[str | list[NumVal]]:
        if not s.args:
            raise StatementError("Nothing to print.")
        if len(s.args) > MOST_PRINTED:
            raise StatementError(f"At most {MOST_PRINTED} handles can be printed.")
        if s.args[0] in self.numbers:
            missing = [a for a in s.args if a not in self.numbers]
            if missing:
                raise StatementError(f"Numeric value {missing[0]} does not exist.")
            return [[self.numbers[a] for a in s.args]]
        return list(self.printed(*s.args))

    def printed(self, *names: str) -> Iterator[str]:
        """Lines of value vectors, in order."""
        for row in self.rows(*names, ordered=True).toLocalIterator(prefetchPartitions=True):
            yield ",".join(str(x) for x in row)

    def rows(self, *names: str, ordered: bool = False) -> DataFrame:
        """Value vectors as columns v0, v1, ... of a DataFrame."""
        found = [self.value(n) for n in names]
        frame = found[0].frame
        for i, v in enumerate(found):
            if v.frame is not frame:
                found[i] = vectors.align(frame, v)
                frame = found[i].frame
        uses = frozenset().union(*(v.uses for v in found), frame.order if ordered else ())
        df = frame.over(uses)
        if self.single:
            df = df.coalesce(1)
        if ordered:
            df = df.sortWithinPartitions(*frame.order) if self.single else df.orderBy(*frame.order)
        return df.select(*(v.column.cast("int").alias(f"v{i}") for i, v in enumerate(found)))

    def position_rows(self, *names: str) -> DataFrame:
        """Aligned position vectors as columns p0, p1, ... of a DataFrame."""
        found = [self.position(n) for n in names]
        at = [vectors.positions(p) for p in found]
        return found[0].frame.over(frozenset(at)).select(*(F.col(a).alias(f"p{i}") for i, a in enumerate(at)))

    def _do_relational_insert(self, s: dsl.Statement) -> None:
        if len(s.args) < 2:
            raise StatementError("Wrong number of arguments for relational_insert.")
        table = self.catalog.table(s.args[0])
        table.complete()
        row = tuple(dsl.number(x) for x in s.args[1:])
        if len(row) != table.arity:
            raise StatementError("One value for each column required.")
        if not all(-(2**31) <= x < 2**31 for x in row):
            raise StatementError("Value out of range.")
        if self.catalog.add(table, row) >= MOST_WAITING:
            self.flush(table)

    def _do_relational_delete(self, s: dsl.Statement) -> None:
        table, p = self.catalog.table(s.args[0]), self.position(s.args[1])
        self.flush(table)
        dml.delete(self.catalog, self.spark, table, p)

    def _do_relational_update(self, s: dsl.Statement) -> None:
        table, column = self.catalog.column(s.args[0])
        p, x = self.position(s.args[1]), dsl.number(s.args[2])
        self.flush(table)
        dml.update(self.catalog, self.spark, table, column, p, x)

    def _do_batch_queries(self, s: dsl.Statement) -> None:
        if self.batch is not None:
            raise StatementError("Cannot start a new batch before the current one is executed.")
        self.batch = Batch()

    def _do_batch_execute(self, s: dsl.Statement) -> None:
        if self.batch is None:
            raise StatementError("No batch to execute.")
        batch, self.batch = self.batch, None
        found, numbers = batch.run()
        self.positions |= found
        self.numbers |= numbers
        for v in numbers.values():
            v.single = self.single

    def _do_single_core(self, s: dsl.Statement) -> None:
        if self.single:
            raise StatementError("Already in single-core mode.")
        self.single = True

    def _do_single_core_execute(self, s: dsl.Statement) -> None:
        if not self.single:
            raise StatementError("Not in single-core mode.")
        self.single = False

    def describe(self) -> list[str]:
        """What is stored: one line per table."""
        self.flush_all()
        return [f"{self.catalog.db}.{t.name}({', '.join(t.columns)}): {t.version.rows} rows, version {t.number}" + "".join(f", {c} {kind} {'clustered' if own else 'unclustered'}" for c, (kind, own) in t.index.items()) for t in self.catalog.tables.values()]


def _format(v: NumVal) -> str:
    return f"{v.value:.2f}" if v.kind == "avg" else str(v.value)
