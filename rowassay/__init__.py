"""Rule-driven checks, cleaning and profiling of tables, as Spark jobs."""

from rowassay.operators.keys import release
from rowassay.plans.cleaning import Cleaning, clean, preview
from rowassay.plans.report import Outputs, Report, validate
from rowassay.plans.rules import RuleError, find_issues

__all__ = ["Cleaning", "Outputs", "Report", "RuleError", "clean", "find_issues", "preview", "release", "validate"]
