"""Databases, tables, columns, indexes and table versions, kept as one JSON file; rows not yet in a version, as a journal."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

from ..errors import StatementError


@dataclass
class Segment:
    """Parquet files of one write; the position of a row is offsets[__part] + __row."""

    path: str
    offsets: list[int]
    rows: int


@dataclass
class Version:
    segments: list[Segment] = field(default_factory=list)
    indexes: dict[str, str] = field(default_factory=dict)  # column -> path of its sorted projection

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)


@dataclass
class Table:
    name: str
    arity: int
    columns: list[str] = field(default_factory=list)
    index: dict[str, tuple[str, bool]] = field(default_factory=dict)  # column -> (structure, clustered)
    number: int = 0
    version: Version = field(default_factory=Version)
    external: str | None = None  # a parquet file read in place until the table is first changed
    logged: int = 0  # the last journal entry whose row the version has

    @property
    def filled(self) -> bool:
        return self.external is not None or self.version.rows > 0

    @property
    def clustered(self) -> str | None:
        return next((c for c, (_, own) in self.index.items() if own), None)

    def complete(self) -> None:
        if len(self.columns) < self.arity:
            raise StatementError(f"Table {self.name} is not fully initialized.")

    def check(self, column: str) -> None:
        if column not in self.columns:
            raise StatementError(f"Column {column} does not exist in table {self.name}.")


def valid_name(name: str) -> str:
    if not 0 < len(name.encode()) <= 63 or not all(c.isalnum() or c in "_-" for c in name):
        raise StatementError(f"Invalid name: {name!r}.")
    return name


class Catalog:
    """One database at a time; every change is written at once and atomically.

    Inserted rows wait in `pending` until they become a version. Each is first a line
    of the journal, numbered, and a version is saved with the number of the last row
    it has: after the process is lost at any point, every row is there once.
    """

    def __init__(self, root: str, data: str | None = None):
        """`root` has the catalog file; `data` (default: the same) is where Spark writes versions: a folder that all executors share."""
        self.root = Path(root)
        self.data = (data or root).rstrip("/")
        self.root.mkdir(parents=True, exist_ok=True)
        self.db: str | None = None
        self.tables: dict[str, Table] = {}
        self.made = 0
        self.pending: dict[str, list[tuple[int, ...]]] = {}
        self.entry = 0  # the last journal entry
        self.journal = self.root / "inserts.jsonl"
        path = self.root / "catalog.json"
        if path.exists():
            state = json.loads(path.read_text())
            self.db, self.made = state["db"], state["made"]
            for t in state["tables"]:
                v = t.pop("version")
                t["index"] = {c: tuple(x) for c, x in t["index"].items()}
                self.tables[t["name"]] = Table(**t, version=Version([Segment(**s) for s in v["segments"]], v["indexes"]))
        self._replay()

    def _replay(self) -> None:
        """The journal's rows that no version has; a line that was not written to its end is cut off."""
        self.entry = max((t.logged for t in self.tables.values()), default=0)
        if not self.journal.exists():
            return
        text = self.journal.read_text()
        whole = text[: text.rfind("\n") + 1]
        if whole != text:
            self.journal.write_text(whole)
        for line in whole.splitlines():
            entry, name, row = json.loads(line)
            self.entry = max(self.entry, entry)
            if name in self.tables and entry > self.tables[name].logged:
                self.pending.setdefault(name, []).append(tuple(row))

    def add(self, table: Table, row: tuple[int, ...]) -> int:
        """Take a row, and say how many of the table now wait. The journal outlives the process, not a loss of power."""
        self.entry += 1
        with self.journal.open("a") as f:
            f.write(json.dumps([self.entry, table.name, row]) + "\n")
        rows = self.pending.setdefault(table.name, [])
        rows.append(row)
        return len(rows)

    def settle(self, table: Table) -> None:
        """The table's waiting rows are in a version that has been saved."""
        self.pending.pop(table.name, None)
        if not self.pending:
            self.journal.unlink(missing_ok=True)

    def save(self) -> None:
        path = self.root / "catalog.json"
        new = path.with_suffix(".new")
        new.write_text(json.dumps({"db": self.db, "made": self.made, "tables": [asdict(t) for t in self.tables.values()]}))
        os.replace(new, path)

    def fresh(self, name: str) -> str:
        """A path for new files."""
        self.made += 1
        return f"{self.data}/{name}-{self.made}"

    def create_db(self, name: str) -> None:
        self.db, self.tables, self.pending = valid_name(name), {}, {}
        self.journal.unlink(missing_ok=True)
        self.save()

    def create_table(self, db: str, name: str, arity: int) -> None:
        self.use(db)
        if name in self.tables:
            raise StatementError(f"Table {name} already exists.")
        if arity <= 0:
            raise StatementError("The number of columns must be positive.")
        self.tables[valid_name(name)] = Table(name, arity)
        self.save()

    def create_column(self, table: Table, name: str) -> None:
        if name in table.columns:
            raise StatementError(f"Column {name} already exists.")
        if len(table.columns) >= table.arity:
            raise StatementError(f"Table {table.name} is full.")
        table.columns.append(valid_name(name))
        self.save()

    def use(self, db: str) -> None:
        if self.db is None or db != self.db:
            raise StatementError(f"Database {db} does not exist.")

    def table(self, name: str) -> Table:
        """By its variable db.table."""
        parts = name.split(".")
        if len(parts) != 2:
            raise StatementError(f"Not a table: {name}.")
        self.use(parts[0])
        if parts[1] not in self.tables:
            raise StatementError(f"Table {parts[1]} does not exist.")
        return self.tables[parts[1]]

    def column(self, name: str) -> tuple[Table, str]:
        """By its variable db.table.column."""
        head, _, column = name.rpartition(".")
        table = self.table(head)
        table.check(column)
        return table, column
