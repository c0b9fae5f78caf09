"""Queries on the snapshots themselves."""

from tidemark.plans import adapter
from tidemark.plans.registry import query


@query("company_snapshots", adapter.sql("SELECT * FROM company"))
def company_snapshots(spark, d):
    return adapter.companies(spark, d)


@query("establishment_snapshots", adapter.sql("SELECT * FROM est"))
def establishment_snapshots(spark, d):
    return adapter.establishments(spark, d)


@query("partner_snapshots", adapter.sql("SELECT * FROM partner"))
def partner_snapshots(spark, d):
    return adapter.partners(spark, d)
