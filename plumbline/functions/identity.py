"""Package identity: canonical names, package URLs, CVE ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pypi_name(name: Column) -> Column:
    """PEP 503: runs of ``-_.`` become one dash, ends trimmed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(name, r"[-_.]+", "-"), F.lit("-")))


def feed_name(ecosystem: Column, name: Column) -> Column:
    """Canonical name as advisories index it (PyPI rule, else lower case)."""
    return F.when(F.lower(ecosystem).startswith("pypi"), pypi_name(name)).otherwise(F.lower(name))


def purl_name(ecosystem: Column, name: Column) -> Column:
    """Canonical name inside a package URL; unknown ecosystems keep their case."""
    eco = F.lower(ecosystem)
    return (
        F.when(eco == "pypi", pypi_name(name))
        .when(eco.isin("npm", "cargo", "go"), F.lower(name))
        .otherwise(name)
    )


def coordinate(ecosystem: Column, name: Column, namespace: Column | None = None) -> Column:
    """``pkg:type/[namespace/]name``: identity without a version."""
    space = F.lit(None).cast("string") if namespace is None else namespace
    prefix = F.when(F.coalesce(space, F.lit("")) != "", F.concat(space, F.lit("/"))).otherwise("")
    return F.concat(F.lit("pkg:"), F.lower(ecosystem), F.lit("/"), prefix, purl_name(ecosystem, name))


def purl(ecosystem: Column, name: Column, version: Column, namespace: Column | None = None) -> Column:
    base = coordinate(ecosystem, name, namespace)
    return F.when(
        F.coalesce(version, F.lit("")) != "", F.concat(base, F.lit("@"), version)
    ).otherwise(base)


def cve_candidates(vuln_id: Column, aliases: Column) -> Column:
    """Upper-case CVE ids among the id and its aliases, in order."""
    names = F.concat(F.array(vuln_id), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.filter(F.transform(names, F.upper), lambda n: n.startswith("CVE-"))


def first_cve(vuln_id: Column, aliases: Column) -> Column:
    return F.get(cve_candidates(vuln_id, aliases), F.lit(0))
