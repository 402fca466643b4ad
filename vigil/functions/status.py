"""Status codes, names and script-language labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.schemas import SCRIPT_LANGUAGES, STATUS_NAMES


def code_to_status(code: Column) -> Column:
    """Exit / stored code -> status name: 0 Ok, 1 Warning, 2 Critical,
    4 Pending, anything else (including null) CheckError."""
    return (F.when(code == 0, F.lit(STATUS_NAMES[0]))
            .when(code == 1, F.lit(STATUS_NAMES[1]))
            .when(code == 2, F.lit(STATUS_NAMES[2]))
            .when(code == 4, F.lit(STATUS_NAMES[4]))
            .otherwise(F.lit(STATUS_NAMES[3])))


def status_to_code(name: Column) -> Column:
    """Status name -> stored SMALLINT code (null for a name outside the enum)."""
    expr = None
    for code, status in enumerate(STATUS_NAMES):
        expr = (F.when(name == status, F.lit(code)) if expr is None
                else expr.when(name == status, F.lit(code)))
    return expr.cast("smallint")


def normalize_code(code: Column) -> Column:
    """Code as stored: unknown codes collapse to CheckError (3)."""
    return status_to_code(code_to_status(code))


def language_label(language: Column) -> Column:
    """Python -> python, Bash -> bash; null outside the declared enum."""
    expr = None
    for lang, label in SCRIPT_LANGUAGES.items():
        expr = (F.when(language == lang, F.lit(label)) if expr is None
                else expr.when(language == lang, F.lit(label)))
    return expr
