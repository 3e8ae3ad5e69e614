"""Columns for principals and mail addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a principal looks like; domains of one mailbox provider.
PRINCIPAL = "^(user|group):[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DOTLESS_DOMAINS = ("gmail.com", "googlemail.com")


def valid_principal(value: Column) -> Column:
    return F.trim(value).rlike(PRINCIPAL)


def normalize_email(value: Column) -> Column:
    """Lower case without a +tag; one spelling for the provider that ignores dots."""
    clean = F.lower(F.trim(value))
    at = F.instr(clean, "@")
    local = F.substring_index(F.substring(clean, F.lit(1), at - 1), "+", 1)
    domain = F.substring(clean, at + 1, F.length(clean))
    dotless = domain.isin(*DOTLESS_DOMAINS)
    local = F.when(dotless, F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    return F.when(at == 0, clean).otherwise(F.concat(local, F.lit("@"), F.when(dotless, DOTLESS_DOMAINS[0]).otherwise(domain)))
