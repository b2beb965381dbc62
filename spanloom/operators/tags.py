"""Tags on loci and the predicate language over them.

A tag is a set of uids or a map from uids to values. Queries build one boolean column,
so Catalyst sees a single filter; a tag's values reach the loci by one join a tag.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import uid
from spanloom.operators import overlap
from spanloom.operators.loci import Loci

SCHEMA = "uid string, num double, str string"
_numbers = itertools.count()


def coerced(value: Column) -> tuple[Column, Column]:
    """(num, str) of a text value: the number if it parses as one, else the text."""
    num = value.try_cast("double")
    return num, F.when(num.isNull(), value)


def aliases(name: str) -> set[str]:
    """Lower-case forms of a name: itself, its alphanumeric parts, and the parts joined by _ and by nothing."""
    low = name.lower()
    parts = [p for p in re.split(r"[^0-9a-z]+", low) if p]
    return {low, *parts, "_".join(parts), "".join(parts)} - {""}


class Tags:
    def __init__(self, loci: Loci):
        self.loci, self.spark = loci, loci.df.sparkSession
        self.entries: dict[str, tuple[str, DataFrame]] = {}
        self._aliases: dict[str, set[str]] = {}

    @classmethod
    def make(cls, loci: Loci) -> "Tags":
        return cls(loci)

    def known(self) -> DataFrame:
        return self.loci.df.select(uid().alias("uid")).distinct()

    # store
    def add(self, mapping: Mapping, mode: str = "uid") -> "Tags":
        """mapping: name to Loci, uids, uid-to-value map, or a DataFrame (uid) or (uid, value).

        mode `uid`: loci are matched by their exact uid, KeyError on an unknown one; `overlap`: a
        Loci payload marks the loci that it overlaps.
        """
        if not isinstance(mapping, Mapping):
            raise TypeError("tags are added as a mapping")
        entries = {str(name): self._entry(payload, mode) for name, payload in mapping.items()}
        if mode == "uid" and entries:
            # all tags are checked by one aggregate
            seen = self.loci.df.select(uid().alias("uid"), F.lit(True).alias("there"))
            for _, rows in entries.values():
                seen = seen.unionByName(rows.select("uid", F.lit(False).alias("there")))
            missing = seen.groupBy("uid").agg(F.max("there").alias("there")).where(~F.col("there")).first()
            if missing:
                raise KeyError(missing["uid"])
        for name, entry in entries.items():
            self.entries[name] = entry
            self._aliases[name] = aliases(name)
        return self

    def add_annotations(self, genes) -> "Tags":
        """One set tag for each annotation class of a gene model: the loci that overlap it."""
        sets = genes.annotation_sets()
        for (name,) in sets.select("class").distinct().orderBy("class").collect():
            self.add({name: Loci(sets.where(F.col("class") == name).select("chrom", "start", "end"))}, mode="overlap")
        return self

    def _entry(self, payload, mode: str) -> tuple[str, DataFrame]:
        nil = [F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("str")]
        if isinstance(payload, Loci):
            rows = overlap.intersect(self.loci.df, payload.df) if mode == "overlap" else payload.df
            return "set", rows.select(uid().alias("uid")).distinct().select("uid", *nil)
        if isinstance(payload, DataFrame):
            if "value" not in payload.columns:
                return "set", payload.select("uid").distinct().select("uid", *nil)
            num, text = coerced(F.col("value").cast("string"))
            return "mapping", payload.select("uid", num.alias("num"), text.alias("str"))
        if isinstance(payload, Mapping):
            rows = []
            for key, value in payload.items():
                number = self._number(value)
                rows.append((str(key), number, None if number is not None or value is None else str(value)))
            return "mapping", self.spark.createDataFrame(rows, SCHEMA)
        if isinstance(payload, Iterable) and not isinstance(payload, (str, bytes)):
            return "set", self.spark.createDataFrame([(str(x), None, None) for x in dict.fromkeys(payload)], SCHEMA)
        raise TypeError(f"{type(payload).__name__} is no tag")

    @staticmethod
    def _number(value) -> float | None:
        try:
            return float(value) if value is not None else None
        except (TypeError, ValueError):
            return None

    def resolve(self, name: str) -> str:
        """Exact, then the first in order of adding that fits whatever the case, then by alias; AttributeError if
        none fits, or several by alias."""
        if name in self.entries:
            return name
        own = next((k for k in self.entries if k.lower() == name.lower()), None)
        if own is not None:
            return own
        found = sorted(k for k in self.entries if name.lower() in self._aliases[k])
        if len(found) == 1:
            return found[0]
        if found:
            raise AttributeError(f"{name} may be any of {', '.join(found)}")
        raise AttributeError(f"no tag {name}; there are {', '.join(sorted(self.entries))}")

    # reads
    def __contains__(self, name: str) -> bool:
        try:
            self.resolve(name)
        except AttributeError:
            return False
        return True

    def __getitem__(self, name: str) -> DataFrame:
        return self.entries[self.resolve(name)][1]

    def keys(self) -> list[str]:
        return list(self.entries)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(k, rows) for k, (_, rows) in self.entries.items()]

    def uids(self, name: str) -> DataFrame:
        return self[name].select("uid")

    def long(self) -> DataFrame:
        """(tag, kind, uid, num, str) of all tags."""
        out = self.spark.createDataFrame([], f"tag string, kind string, {SCHEMA}")
        for name, (kind, rows) in self.entries.items():
            out = out.unionByName(rows.select(F.lit(name).alias("tag"), F.lit(kind).alias("kind"), "uid", "num", "str"))
        return out

    def table(self) -> DataFrame:
        """(tag, kind, n) by name."""
        return self.long().groupBy("tag", "kind").agg(F.count("*").alias("n")).orderBy("tag")

    # queries
    def query(self, fn: Callable) -> Loci:
        """The loci that fn's result selects, in their order and with their duplicates."""
        return self._as_selection(fn(Accessor(self))).to_loci()

    def _as_selection(self, result) -> "Selection":
        if isinstance(result, Selection):
            return result
        if isinstance(result, (Pending, NumericView)):
            raise ValueError("a value needs a comparison")
        if isinstance(result, Loci):
            return Selection.of(self, result.df.select(uid().alias("uid")))
        if isinstance(result, Iterable) and not isinstance(result, (str, bytes)):
            return Selection.of(self, self.spark.createDataFrame([(str(x),) for x in result], "uid string"))
        raise TypeError(f"{type(result).__name__} is no selection")


class Accessor:
    """l.name and l["name"] of a query."""

    def __init__(self, tags: Tags):
        object.__setattr__(self, "_tags", tags)

    def __getattr__(self, name: str):
        key = self._tags.resolve(name)
        kind, rows = self._tags.entries[key]
        return NumericView(self._tags, key) if kind == "mapping" else Selection.of(self._tags, rows.select("uid"))

    __getitem__ = __getattr__


class Selection:
    """A condition over the uids' columns, each of which is one join."""

    def __init__(self, tags: Tags, condition: Column, sources: dict[str, DataFrame]):
        self.tags, self.condition, self.sources = tags, condition, sources

    @classmethod
    def of(cls, tags: Tags, uids: DataFrame) -> "Selection":
        name = f"_t{next(_numbers)}"
        rows = uids.distinct().select("uid", F.lit(True).alias(name))
        out = cls(tags, F.coalesce(F.col(name), F.lit(False)), {name: rows})
        return out

    def _other(self, other) -> "Selection":
        if isinstance(other, (NumericView, Pending)):
            raise TypeError("a value needs a comparison")
        if isinstance(other, (Selection, Loci)) or isinstance(other, Iterable) and not isinstance(other, (str, bytes)):
            out = self.tags._as_selection(other)
            missing = None if isinstance(other, Selection) else next(iter(out.sources.values())).join(self.tags.known(), "uid", "left_anti").first()
            if missing:
                raise KeyError(missing["uid"])
            return out
        raise TypeError(f"{type(other).__name__} is no selection")

    def _combine(self, other, f: Callable[[Column, Column], Column], swap: bool = False) -> "Selection":
        o = self._other(other)
        a, b = (o, self) if swap else (self, o)
        return Selection(self.tags, f(a.condition, b.condition), self.sources | o.sources)

    def __and__(self, other):
        if isinstance(other, NumericView):
            return Pending(self, other)
        return self._combine(other, operator.and_)

    def __rand__(self, other):
        return self._combine(other, operator.and_, True)

    def __or__(self, other):
        return self._combine(other, operator.or_)

    __ror__ = __or__

    def __sub__(self, other):
        return self._combine(other, lambda a, b: a & ~b)

    def __rsub__(self, other):
        return self._combine(other, lambda a, b: a & ~b, True)

    def __xor__(self, other):
        return self._combine(other, lambda a, b: a != b)

    __rxor__ = __xor__

    def frame(self) -> DataFrame:
        """The selected loci."""
        out = self.tags.loci.df.withColumn("uid", uid())
        for rows in self.sources.values():
            out = out.join(rows, "uid", "left")
        return out.where(self.condition).select("chrom", "start", "end", "strand", "ord")

    def to_loci(self) -> Loci:
        return Loci(self.frame())

    def uids(self) -> DataFrame:
        if any(len(rows.columns) > 2 for rows in self.sources.values()):
            return self.frame().select(uid().alias("uid")).distinct()
        # of sets alone: one aggregate of marks instead of a join a set
        marks = self.tags.loci.df.select(uid().alias("uid"), F.lit(True).alias("__there"))
        for name, rows in self.sources.items():
            marks = marks.unionByName(rows.select("uid", name), allowMissingColumns=True)
        met = marks.groupBy("uid").agg(*[F.max(c).alias(c) for c in ("__there", *self.sources)])
        return met.where(F.col("__there") & self.condition).select("uid")

    def __len__(self) -> int:
        return self.uids().count()

    def __iter__(self):
        return (r[0] for r in self.uids().toLocalIterator())

    def __contains__(self, key: str) -> bool:
        return not self.uids().where(F.col("uid") == key).isEmpty()


class NumericView:
    """A tag's values. A locus without a value fits no comparison, != neither; text fits only != and == with text."""

    __hash__ = None

    def __init__(self, tags: Tags, key: str):
        self.tags, self.key, self.rows = tags, key, tags.entries[key][1]

    def _compare(self, other, op: Callable) -> Selection:
        if isinstance(other, (Selection, NumericView, Pending)):
            raise TypeError("values are compared with constants")
        num, text = f"_n{id(self.rows):x}", f"_s{id(self.rows):x}"
        rows = self.rows.select("uid", F.col("num").alias(num), F.col("str").alias(text))
        n, s = F.col(num), F.col(text)
        unequal = op is operator.ne
        if isinstance(other, str):
            same_kind = op(s, F.lit(other))
            rest = n.isNotNull() if unequal else F.lit(False)
            condition = F.when(s.isNotNull(), same_kind).otherwise(rest)
        elif isinstance(other, (int, float)):
            nan = F.isnan(n) | F.lit(other != other)
            number = F.when(nan, F.lit(unequal)).otherwise(op(n, F.lit(float(other))))
            condition = F.when(n.isNotNull(), number).otherwise(s.isNotNull() if unequal else F.lit(False))
        else:
            condition = F.lit(unequal) & (n.isNotNull() | s.isNotNull())
        return Selection(self.tags, F.coalesce(condition, F.lit(False)), {num: rows})

    def __gt__(self, other):
        return self._compare(other, operator.gt)

    def __ge__(self, other):
        return self._compare(other, operator.ge)

    def __lt__(self, other):
        return self._compare(other, operator.lt)

    def __le__(self, other):
        return self._compare(other, operator.le)

    def __eq__(self, other):
        return self._compare(other, operator.eq)

    def __ne__(self, other):
        return self._compare(other, operator.ne)

    def __and__(self, other):
        if isinstance(other, (NumericView, Pending)):
            raise TypeError("a value needs a comparison")
        return Pending(self.tags._as_selection(other), self)

    __rand__ = __and__

    def __getitem__(self, key: str):
        row = self.rows.where(F.col("uid") == key).first()
        if row is None or row["num"] is None and row["str"] is None:
            raise KeyError(key)
        return row["num"] if row["num"] is not None else row["str"]

    def keys(self) -> DataFrame:
        return self.rows.select("uid")

    def items(self) -> DataFrame:
        return self.rows


class Pending:
    """selection & value, which a comparison completes: `l.a & l.x > 1` reads as (l.a & l.x) > 1."""

    __hash__ = None

    def __init__(self, base: Selection, view: NumericView):
        self.base, self.view = base, view

    def _refuse(self, other):
        raise TypeError("a value needs a comparison")

    __and__ = __rand__ = __or__ = __ror__ = __sub__ = __rsub__ = __xor__ = __rxor__ = _refuse

    def __gt__(self, other):
        return self.base & (self.view > other)

    def __ge__(self, other):
        return self.base & (self.view >= other)

    def __lt__(self, other):
        return self.base & (self.view < other)

    def __le__(self, other):
        return self.base & (self.view <= other)

    def __eq__(self, other):
        return self.base & (self.view == other)

    def __ne__(self, other):
        return self.base & (self.view != other)
