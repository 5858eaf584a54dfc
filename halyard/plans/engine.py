"""Embedding facade and interactive shell over the star tables."""

from __future__ import annotations

import os
import re
import signal
import sys
import time
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from halyard.functions import dialect
from halyard.functions.dialect import QueryError
from halyard.operators.joins import split_or_joins
from halyard.operators.reorder import changed, count_before_join, deal_evenly, move_down
from halyard.sources.star import Star

_UNITS = {"": 1, "b": 1, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}


@dataclass
class Config:
    """Settings from a ``key=value`` file; ``#`` and ``;`` begin comments, unknown keys are errors."""

    display_rows: int = 1000
    memory_limit: int = 0
    reserve_fraction: float = 0.1
    shuffle_partitions: int = 0

    @classmethod
    def parse(cls, text: str) -> Config:
        out, kinds = cls(), {f.name: f.type for f in fields(cls)}
        for number, line in enumerate(text.splitlines(), 1):
            line = re.split(r"[#;]", line, maxsplit=1)[0].strip()
            if not line:
                continue
            key, equals, value = (x.strip() for x in line.partition("="))
            if not equals or key not in kinds:
                raise QueryError(f"line {number}: unknown setting {key!r}")
            setattr(out, key, float(value) if kinds[key] == "float" else parse_size(value))
        if not 0 <= out.reserve_fraction <= 0.9:
            raise QueryError("reserve_fraction must be from 0 to 0.9")
        return out

    @classmethod
    def load(cls) -> Config:
        """The first file there is: $HALYARD_CONFIG, halyard.conf, ~/.config/halyard/config.conf; without one, the defaults."""
        named = [os.environ["HALYARD_CONFIG"]] if os.environ.get("HALYARD_CONFIG") else []
        for path in map(Path, [*named, "halyard.conf", Path.home() / ".config/halyard/config.conf"]):
            if path.is_file():
                return cls.parse(path.read_text())
        return cls()

    def settings(self, cores: int) -> dict[str, str]:
        """Session settings: with a memory limit, its unreserved part is shared by the cores, each with room for a few partitions."""
        out = {"spark.sql.shuffle.partitions": str(self.shuffle_partitions)} if self.shuffle_partitions else {}
        if self.memory_limit:
            usable = self.memory_limit * (1 - self.reserve_fraction)
            share = max(1 << 20, int(usable / cores / 8))
            out["spark.sql.files.maxPartitionBytes"] = str(min(share, 128 << 20))
            out["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(min(share, 64 << 20))
            out["spark.sql.autoBroadcastJoinThreshold"] = str(min(int(usable / 64), 10 << 20))
        return out


def parse_size(text: str) -> int:
    """A whole number with an optional unit from B to GiB."""
    found = re.fullmatch(r"(\d+)\s*([a-zA-Z]*)", text.strip())
    if not found or found[2].lower() not in _UNITS:
        raise QueryError(f"not a size: {text!r}")
    return int(found[1]) * _UNITS[found[2].lower()]


def statements(text: str) -> list[str]:
    """Cut a script at semicolons outside of quotes and comments."""
    parts, now, at = [], [], 0
    for m in re.finditer(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|;", text, re.S):
        now.append(text[at : m.start()])
        at = m.end()
        if m[0] == ";":
            parts.append("".join(now))
            now = []
        elif not m[0].startswith(("--", "/*")):
            now.append(m[0])
    return [p.strip() for p in [*parts, "".join(now) + text[at:]] if p.strip()]


class Engine:
    """``sql`` gives DataFrames over the star views; ``explain`` the plan; ``tail`` the last rows.

    With ``store``, the views read star tables written there by ``Star.store``, else they are derived from the inputs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, config: Config | None = None, store: str | None = None):
        self.spark, self.config, self.star = spark, config or Config(), Star(spark, sf_dir, store)
        for key, value in self.config.settings(spark.sparkContext.defaultParallelism).items():
            spark.conf.set(key, value)
        self.star.register()

    def cache(self) -> None:
        """Keep the views in memory (and on disk, where memory ends)."""
        for name in ("lineorder", "ddate", "customer", "supplier", "part"):
            self.spark.catalog.cacheTable(name)

    def sql(self, text: str) -> DataFrame:
        """The last of the statements in ``text``; all must be queries, and output names must differ."""
        found = statements(text)
        if not found:
            raise QueryError("no statement")
        for s in found:
            if not re.match(r"\(*\s*(select|with|values|from)\b", s, re.I):
                raise QueryError("only queries are allowed")
            dialect.check_aggregates(s)
        text = dialect.nulls_last(dialect.case_when(found[-1]))
        text = dialect.whole_division(text, lambda t: self.spark.sql(t)._jdf.queryExecution().analyzed())
        df = split_or_joins(self.spark.sql(text))
        for change in (count_before_join, move_down, deal_evenly):
            df = changed(df, change)
        names = [c.lower() for c in df.columns]
        if twice := {c for c in names if names.count(c) > 1}:
            raise QueryError(f"duplicate SELECT alias: {', '.join(sorted(twice))}")
        return df

    def explain(self, text: str, mode: str = "formatted") -> str:
        df = self.sql(text)
        jvm = self.spark.sparkContext._jvm
        return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def tail(self, text: str, rows: int | None = None) -> tuple[list, int, list[str]]:
        """The last rows, the number of all rows, and the column names; the query runs once, its result is kept meanwhile."""
        df = self.sql(text).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = df.count()
            return df.tail(self.config.display_rows if rows is None else rows), n, df.columns
        finally:
            df.unpersist()


class Shell:
    """Reads SQL up to a semicolon, and commands that begin with a backslash or a dot."""

    HELP = r"\q | .exit | help | \o [file] | \echo text | \ast on|off | \logical on|off | \dump on|off | \timing on|off | \limit N|all|on|off"

    def __init__(self, engine: Engine, out=None):
        self.engine, self.out = engine, out or sys.stdout
        self.flags = {"ast": False, "logical": False, "dump": False, "timing": True}
        self.limit: int | None = engine.config.display_rows
        self.target: str | None = None

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def command(self, line: str) -> bool:
        """Run a command; False ends the shell."""
        name, _, rest = line.strip().partition(" ")
        name, rest = name.lstrip("\\."), rest.strip()
        if name in ("q", "exit"):
            return False
        if name == "help":
            self.say(self.HELP)
        elif name == "o":
            self.target = rest or None
        elif name == "echo":
            self.say(rest)
        elif name in self.flags and rest in ("on", "off"):
            self.flags[name] = rest == "on"
        elif name == "limit" and (rest in ("all", "off", "on") or rest.isdecimal()):
            self.limit = None if rest in ("all", "off") else self.engine.config.display_rows if rest == "on" else int(rest)
        else:
            self.say(f"[ERROR] unknown command: {line.strip()}")
        return True

    def run(self, text: str) -> None:
        try:
            begun = time.time()
            for flag, mode in (("ast", "extended"), ("logical", "cost"), ("dump", "codegen")):
                if self.flags[flag]:
                    plan = self.engine.explain(text, mode)
                    if self.target and flag == "dump":
                        with open(self.target, "a") as f:
                            f.write(plan + "\n")
                    else:
                        self.say(plan)
            if self.limit is None:
                df = self.engine.sql(text)
                n, first, rows, names = 0, 0, df.toLocalIterator(), df.columns  # a partition at a time
            else:
                rows, n, names = self.engine.tail(text, self.limit)
                first = n - len(rows)
            self.say("Columns: " + ", ".join(names))
            for i, row in enumerate(rows, first):
                self.say(f"Row {i}: " + " | ".join("NULL" if v is None else str(v) for v in row))
                n = max(n, i + 1)
            self.say(f"Rows returned: {n}")
            if self.flags["timing"]:
                self.say(f"Time: {time.time() - begun:.3f} s")
        except KeyboardInterrupt:
            self.engine.spark.sparkContext.cancelAllJobs()
            self.say("Query cancelled.")
        except Exception as e:  # a failed statement doesn't end the shell
            self.say(f"[ERROR] {(str(e).splitlines() or [type(e).__name__])[0]}")

    def loop(self, lines) -> None:
        held = ""
        for line in lines:
            if not held and (line.lstrip().startswith(("\\", ".")) or line.strip() == "help"):
                if not self.command(line):
                    return
                continue
            held += line
            if held.rstrip().endswith(";"):
                self.run(held)
                held = ""
        if held.strip():
            self.say("Query cancelled.")


def lines_from(stream):
    """Lines of a terminal, with prompts; an interrupt at the prompt drops the line."""
    while True:
        try:
            yield input("halyard> ") + "\n" if stream.isatty() else next(stream)
        except KeyboardInterrupt:
            print()
        except (EOFError, StopIteration):
            return


def main(arguments: list[str] | None = None) -> None:
    """``python -m halyard FOLDER``: the shell over the tables of a folder."""
    arguments = sys.argv[1:] if arguments is None else arguments
    if len(arguments) != 1:
        raise SystemExit("usage: python -m halyard FOLDER")
    spark = SparkSession.builder.appName("halyard").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    signal.signal(signal.SIGINT, signal.default_int_handler)
    Shell(Engine(spark, arguments[0], Config.load())).loop(lines_from(sys.stdin))
    spark.stop()
