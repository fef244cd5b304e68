from .catalog import ALL_RULES, DOCUMENTED_RULES, SHIPPED_RULES, rule
from .spec import FILE, LINE, Pattern, RuleSpec

__all__ = ["ALL_RULES", "DOCUMENTED_RULES", "SHIPPED_RULES", "rule", "FILE", "LINE", "Pattern", "RuleSpec"]
