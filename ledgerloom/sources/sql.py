"""Ad-hoc SQL under a row cap and a time limit."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import redact_value

#: Calls into the machine, and tables named by a file format and a path.
REFUSED = r"(?i)\b(?:try_)?(?:reflect|java_method)`?\s*\(|`?\b(?:parquet|orc|csv|json|text|avro|binaryfile|delta|hive|jdbc)`?\s*\.\s*`"


def read_only(spark: SparkSession, sql: str, max_rows: int, redacted: bool = True) -> DataFrame:
    """Rows of one query, one more than ``max_rows`` at most (a caller that gets it knows the rest was cut).

    The text is parsed as the inner part of a query, where commands, statements that write and second statements do not
    parse. Calls into the machine and paths as tables are refused wherever they stand, quoted text aside. All strings
    of the rows, nested ones too, are redacted unless ``redacted`` is False.
    """
    inner = sql.strip().rstrip(";")
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", re.sub(r"'(?:[^'\\\\]|\\\\.)*'", "''", inner), flags=re.S)
    if not re.match(r"(?i)\s*\(*\s*(select|with|values|from)\b", bare) or ";" in bare or re.search(REFUSED, bare) or re.search(r"(?i)\b(insert|overwrite|into)\b", bare):
        raise ValueError("only a query is allowed")
    rows = spark.sql(f"SELECT * FROM ({inner}\n) LIMIT {int(max_rows) + 1}")
    if not redacted:
        return rows
    return rows.select(*[redact_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])


def read_within(spark: SparkSession, sql: str, max_rows: int, seconds: float, redacted: bool = True) -> tuple[list[Row], bool]:
    """(rows, truncated) of one query: at most ``max_rows`` rows, and whether there were more. Refuses what :func:`read_only` refuses.

    A query that isn't done after ``seconds`` is a TimeoutError, by which time its jobs are cancelled by a tag of their own and
    their tasks interrupted; other jobs of the session go on. Analysis and planning count; a job that starts late is cancelled too.
    """
    context, tag, done, late = spark.sparkContext, f"read_within_{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        late.set()
        while True:  # a query can start further jobs after one was cancelled
            context.cancelJobsWithTag(tag)
            if done.wait(0.2):
                return

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    watcher.start()
    try:
        rows = read_only(spark, sql, max_rows, redacted).collect()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from error
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)
    if late.is_set():
        raise TimeoutError(f"stopped after {seconds} s")
    return rows[:max_rows], len(rows) > max_rows
