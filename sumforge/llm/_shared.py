"""What the operators share: tables, names and word-wise tokenisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sumforge.operators.work import written  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Memo(dict):
    """A bounded memo: computes what is missing; when full, what was not asked for since the last time goes."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit // 2, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


class WordWise:
    """Evaluates a function that is additive over the matches of the GPT-2 style split pattern, one white-space word at a time.

    Where every white-space run of a text is a single space or line feed between two words, each word with its leading
    space is a union of whole pattern matches, and so is each line feed; so the words can be looked up in a memo. Any other
    text is split by the pattern itself. unit(str) is the value of a string on its own.
    """

    def __init__(self, unit: Callable[[str], object], split: Callable[[str], list[str]], limit: int = 800_000):
        self.bare = Memo(unit, limit // 4)
        self.spaced = Memo(lambda w: unit(" " + w), limit)
        self.split = split

    def values(self, text: str) -> list:
        words = text.split()
        gaps = text.count(" ") + text.count("\n")
        if len(words) != gaps + 1 or sum(map(len, words)) + gaps != len(text):
            return list(map(self.bare.__getitem__, self.split(text)))
        if gaps == 0:
            return [self.bare[text]]
        bare, spaced, out = self.bare, self.spaced.__getitem__, []
        feed = bare["\n"]
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(feed)
            first, *rest = line.split(" ")
            out.append(bare[first])
            out.extend(map(spaced, rest))
        return out


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string expression."""
    code = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda a, b: {bits}), 4294967295)"
