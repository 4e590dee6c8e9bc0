"""An interactive shell: statements, meta commands, scripts and printed tables."""

from __future__ import annotations

import inspect
import re
import sys
from collections.abc import Callable, Iterable, Sequence
from typing import TextIO

from tessera.engine import Engine, Result
from tessera.errors import CatalogError
from tessera.sources.catalog import type_name

PROMPT, MORE = "tessera> ", "....> "

_PIECES = re.compile(r"'[^']*'?|--[^\n]*|/\*.*?(?:\*/|\Z)|;|.", re.S)


def split_statements(script: str) -> list[str]:
    """Statements with their semicolons; those in strings and comments don't end one. Empty statements are left out."""
    found, now = [], ""
    for piece in _PIECES.findall(script):
        now += piece
        if piece == ";":
            found.append(now)
            now = ""
    return [s for s in [*found, now] if s.strip(" \t\r\n;")]


def _cut(text: str) -> list[str]:
    """Whole statements, and last what no semicolon ends yet."""
    found = split_statements(text)
    open_end = found and not _PIECES.findall(found[-1])[-1] == ";"
    return found if open_end else [*found, ""]


def shown(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def print_table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """An ASCII table; nothing without columns."""
    if not columns:
        return ""
    cells = [list(columns), *[[shown(v) for v in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    rule = "+" + "".join("-" * (w + 2) + "+" for w in widths) + "\n"
    head, *body = ["|" + "".join(f" {c:<{w}} |" for c, w in zip(r, widths, strict=True)) + "\n" for r in cells]
    return rule + head + rule + "".join(body) + (rule if body else "")


def row_count(n: int) -> str:
    return f"({n} row{'' if n == 1 else 's'})\n"


def render(r: Result) -> str:
    if not r.success:
        return f"Error: {r.error}\n"
    if r.kind != "rows":
        return r.message + "\n" * (not r.message.endswith("\n"))
    return print_table([n for n, _ in r.columns], r.rows) + row_count(len(r.rows))


def run_script(engine: Engine, path: str) -> str:
    """Run a file's statements up to the first that fails."""
    try:
        with open(path) as f:
            statements = split_statements(f.read())
    except OSError as e:
        return f"Error: {path}: {e.strerror}\n"
    out = ""
    for n, s in enumerate(statements, 1):
        r = engine.try_execute(s)
        out += render(r)
        if not r.success:
            return f"{out}{path}: stopped at statement {n} of {len(statements)}: {s.strip()}\n"
    return f"{out}{path}: {len(statements)} done\n"


class Shell:
    """Meta commands are the methods ``do_<name>``: ``.help`` shows their arguments and documentation."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def sql(self, text: str) -> str:
        return render(self.engine.try_execute(text))

    def commands(self) -> dict[str, Callable[..., str]]:
        return {"." + n.removeprefix("do_"): getattr(self, n) for n in sorted(dir(type(self))) if n.startswith("do_")}

    def meta(self, line: str) -> str:
        name, *arguments = line.split()
        command = self.commands().get(name)
        if command is None:
            return f"Error: {name} is none of " + " ".join(self.commands()) + "\n"
        wanted = list(inspect.signature(command).parameters)
        if len(arguments) < len(wanted):
            return f"Error: {name} needs a " + " and a ".join(wanted) + "\n"
        try:
            return command(*arguments[: len(wanted)])
        except CatalogError as e:
            return f"Error: {e}\n"

    def _columns(self, table: str) -> list[tuple[str, str]]:
        return [(f.name, type_name(f.dataType.simpleString())) for f in self.engine.table(table).schema.fields]

    def do_help(self) -> str:
        """What can be typed besides SQL"""
        rows = [(" ".join([n, *(a.upper() for a in inspect.signature(c).parameters)]), inspect.getdoc(c)) for n, c in self.commands().items()]
        return print_table(["command", "gives"], rows)

    def do_exit(self) -> str:
        """The end of the session"""
        return ""

    do_quit = do_exit

    def do_tables(self) -> str:
        """The catalog's tables and the registered ones, a line each"""
        return "".join(f"{t}\n" for t in self.engine.catalog.list_tables())

    def do_schema(self, table: str) -> str:
        """SQL that makes an empty table of the same shape"""
        return f"CREATE TABLE {table} (\n" + ",\n".join(f"    {c} {t}" for c, t in self._columns(table)) + "\n);\n"

    def do_describe(self, table: str) -> str:
        """Columns and their types"""
        return print_table(["column", "type"], self._columns(table))

    def do_indexes(self, table: str) -> str:
        """How a scan of the table can skip files"""
        (key, _), *_ = self._columns(table)
        if table in self.engine.catalog.external:
            return f"{table}: by whatever statistics its Parquet files have\n"
        return f"{table}: every file is sorted by {key}, whose least and greatest values it names\n"

    def do_stats(self) -> str:
        """Counts of what this engine has at the moment"""
        e = self.engine
        m = e.catalog.manifest()
        segments = [s for t in m["tables"].values() for s in t["segments"]]
        facts = {
            "manifest": m["version"],
            "tables in the catalog": len(m["tables"]),
            "tables registered": len(e.catalog.external),
            "segments": len(segments),
            "segments with files left out": sum(s["files"] is not None for s in segments),
            "transactions open": len(e.transactions.active),
            "statements prepared": len(e.prepared),
            "shuffle partitions": e.spark.conf.get("spark.sql.shuffle.partitions"),
        }
        return print_table(["fact", "value"], list(facts.items()))

    def do_read(self, file: str) -> str:
        """Results of a script's statements, up to the first error"""
        return run_script(self.engine, file)

    def run(self, lines: Iterable[str], out: TextIO = sys.stdout) -> None:
        """Read lines up to ``.exit``; a statement may take several and ends with the line that has its semicolon."""
        held = ""
        out.write(PROMPT)
        for line in lines:
            text = line.strip()
            if not held and text.startswith("."):
                if text in (".exit", ".quit"):
                    return
                out.write(self.meta(text))
            elif text:
                held += line.rstrip("\n") + "\n"
                *whole, rest = _cut(held)
                for s in whole:
                    out.write(self.sql(s))
                held = rest if rest.strip() else ""
            out.write(MORE if held else PROMPT)
            out.flush()


def main(arguments: Sequence[str] | None = None) -> None:
    """``python -m tessera.shell.shell [folder of the catalog]``"""
    from pyspark.sql import SparkSession

    given = list(sys.argv[1:] if arguments is None else arguments)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    Shell(Engine(spark, given[0] if given else "tessera-data")).run(sys.stdin)


if __name__ == "__main__":
    main()
