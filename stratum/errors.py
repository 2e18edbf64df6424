"""Errors that a statement can give; they never end a session."""

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException


class StatementError(Exception):
    """A statement that cannot be parsed, bound or carried out."""


#: What a job or a plan may raise while a statement runs.
FAILURES = (PySparkException, Py4JJavaError)


def message(e: Exception) -> str:
    """One line that says what failed."""
    text = str(e)
    found = re.search(r"(?:SparkRuntimeException|SparkException|SparkArithmeticException|SparkNumberFormatException|AnalysisException): (\[[A-Z_.]+\][^\n]*)", text)
    line = (found[1] if found else text.strip().split("\n")[0]).removeprefix("[USER_RAISED_EXCEPTION] ")
    return re.sub(r"\s*SQLSTATE: \w+.*$", "", line)
