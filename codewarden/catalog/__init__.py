"""Rule catalogs as data."""

from codewarden.catalog.malicious import MALICIOUS_RULES
from codewarden.catalog.model import ANALYZER_ORDER, Check, Rule
from codewarden.catalog.policy import DEFAULT_ACTIVE, POLICY_RULES
from codewarden.catalog.shell import SHELL_RULES
from codewarden.catalog.vulnerability import VULNERABILITY_RULES

__all__ = ["ANALYZER_ORDER", "Check", "DEFAULT_ACTIVE", "MALICIOUS_RULES", "POLICY_RULES", "Rule",
           "SHELL_RULES", "VULNERABILITY_RULES"]
