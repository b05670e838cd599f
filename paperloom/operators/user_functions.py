"""A caller's own checks and site handlers, run beside the built-in ones.

Plain functions of a row's values are registered by name; they run in Arrow batches, all checks of a row in one pass,
and a handler only on the rows of its site. A function that raises fails its check, or gives no answer, and says so:
one bad row does not end the job. `line_function` makes a table function of the checks for SQL, whose columns follow
the table and the checks it is called with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from paperloom.session import ship_package

Check = Callable[..., tuple[bool, str]]
Handler = Callable[..., str | None]


def _checked(check: Check, values: tuple) -> tuple[bool, str]:
    try:
        passed, message = check(*values)
        return bool(passed), str(message)
    except Exception as e:  # noqa: BLE001 - a caller's function may raise anything
        return False, f"{type(e).__name__}: {e}"


class Checks:
    """Named checks of outputs. A check takes the values of its fields and gives (passed, message)."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[list[str], Check]] = {}

    def register(self, name: str, *fields: str) -> Callable[[Check], Check]:
        def add(check: Check) -> Check:
            self.known[name] = (list(fields), check)
            return check

        return add

    def run(self, df: DataFrame, key: str = "id") -> DataFrame:
        """One row per row and check: key, name, passed, message. Only the fields that checks take are read."""
        ship_package(df.sparkSession)
        fields = list(dict.fromkeys(f for own, _ in self.known.values() for f in own))
        plan = [(name, [fields.index(f) for f in own], check) for name, (own, check) in self.known.items()]
        item = pa.struct([("name", pa.string()), ("passed", pa.bool_()), ("message", pa.string())])

        @F.arrow_udf("array<struct<name: string, passed: boolean, message: string>>")
        def results(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                rows = zip(*(batch.field(i).to_pylist() for i in range(batch.type.num_fields)))
                out = []
                for row in rows:
                    found = [(name, *_checked(check, tuple(row[i] for i in own))) for name, own, check in plan]
                    out.append([{"name": n, "passed": p, "message": m} for n, p, m in found])
                yield pa.array(out, pa.list_(item))

        made = results(F.struct(*[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)]))
        return df.select(F.col(key), F.explode(made).alias("c")).select(key, "c.name", "c.passed", "c.message")


class Sites:
    """Handlers by domain suffix. The first one registered that fits a page's host answers; a host fits a suffix if it is the
    suffix or ends with a dot and the suffix."""

    def __init__(self) -> None:
        self.known: list[tuple[str, Handler]] = []

    def register(self, suffix: str) -> Callable[[Handler], Handler]:
        def add(handler: Handler) -> Handler:
            self.known.append((suffix.lower(), handler))
            return handler

        return add

    def site_of(self, url: Column) -> Column:
        """The registered suffix that answers for a URL, else null."""
        host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
        return F.coalesce(*[F.when((host == s) | F.endswith(host, F.lit("." + s)), s) for s, _ in self.known], F.lit(None).cast("string"))

    def answers(self, pages: DataFrame, *fields: str, url: str = "url") -> DataFrame:
        """The pages whose site has a handler, with `site`, `answer` and `error`. Handlers take the values of `fields`; rows without a
        handler never reach Python."""
        ship_package(pages.sparkSession)
        known: dict[str, Handler] = {}
        for suffix, handler in self.known:
            known.setdefault(suffix, handler)

        @F.arrow_udf("struct<answer: string, error: string>")
        def answer(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            kind = pa.struct([("answer", pa.string()), ("error", pa.string())])
            for sites, values in batches:
                rows = zip(sites.to_pylist(), *(values.field(i).to_pylist() for i in range(values.type.num_fields)))
                out = []
                for site, *row in rows:
                    try:
                        out.append({"answer": known[site](*row), "error": None})
                    except Exception as e:  # noqa: BLE001 - as for checks
                        out.append({"answer": None, "error": f"{type(e).__name__}: {e}"})
                yield pa.array(out, kind)

        mine = pages.withColumn("site", self.site_of(F.col(url))).filter("site IS NOT NULL")
        made = answer(F.col("site"), F.struct(*[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)]))
        return mine.withColumn("_a", made).withColumns({"answer": F.col("_a.answer"), "error": F.col("_a.error")}).drop("_a")


def line_function(spark: SparkSession, name: str, checks: Checks) -> None:
    """Register a table function: `SELECT * FROM name(TABLE(t), 'check,check')` gives the rows of any table t with a column of
    verdict and of message per check named. A check's fields are columns of t, found by name."""
    ship_package(spark)
    known = dict(checks.known)

    class Lines:
        @staticmethod
        def analyze(rows: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or not names.isConstantExpression:
                raise ValueError("a table and a constant list of check names are needed")
            asked = [n.strip() for n in names.value.split(",") if n.strip()]
            have = {f.name for f in rows.dataType.fields}
            for n in asked:
                if n not in known:
                    raise ValueError(f"no check named {n}")
                if missing := [f for f in known[n][0] if f not in have]:
                    raise ValueError(f"{n} needs {', '.join(missing)}")
            schema = StructType(list(rows.dataType.fields))
            for n in asked:
                schema = schema.add(f"{n}_passed", BooleanType()).add(f"{n}_message", StringType())
            return AnalyzeResult(schema)

        def eval(self, row, names):
            out = list(row)
            for n in (x.strip() for x in names.split(",") if x.strip()):
                own, check = known[n]
                out += _checked(check, tuple(row[f] for f in own))
            yield tuple(out)

    spark.udtf.register(name, F.udtf(Lines))
