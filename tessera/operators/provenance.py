"""Run manifests, derived configurations, gates."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame

from tessera.functions.digests import canonical_json_sha256


def run_manifest(df: DataFrame, config: dict, inputs: dict[str, str]) -> dict:
    """PRV1: what a run was: hashes of its configuration, inputs and logical plan, and versions."""
    plan = df._jdf.queryExecution().analyzed().canonicalized().semanticHash()
    return {"config_sha256": canonical_json_sha256(config), "inputs": dict(sorted(inputs.items())), "plan_hash": int(plan), "spark": df.sparkSession.version, "python": sys.version.split()[0], "schema": df.schema.jsonValue()}


def changed_fields(base: dict, derived: dict, prefix: str = "") -> list[str]:
    """PRV2: dotted names of the fields in which two configurations differ."""
    out = []
    for k in sorted(set(base) | set(derived)):
        a, b = base.get(k), derived.get(k)
        if isinstance(a, dict) and isinstance(b, dict):
            out += changed_fields(a, b, f"{prefix}{k}.")
        elif a != b or (k in base) != (k in derived):
            out.append(prefix + k)
    return out


def derive(base: dict, changes: dict[str, object], allowed: set[str]) -> dict:
    """PRV2: a configuration with dotted fields changed, all of which must be allowed."""
    if extra := set(changes) - allowed:
        raise ValueError(f"fields may not change: {sorted(extra)}")
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in base.items()}
    for name, value in changes.items():
        at, *rest = name.split(".")
        if rest:
            out[at] = derive(out.get(at, {}), {".".join(rest): value}, {".".join(rest)})
        else:
            out[at] = value
    return out


def check_destination(name: str, allowed: set[str]) -> None:
    """PRV4."""
    if name not in allowed:
        raise ValueError(f"destination is not allowed: {name}")


def unlocked(partition: str, locked: set[str], permitted: bool) -> None:
    """PRV3: a locked part needs an explicit permission."""
    if partition in locked and not permitted:
        raise PermissionError(partition)
