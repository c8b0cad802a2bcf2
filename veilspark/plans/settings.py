"""Rule settings kept in a shared folder, a snapshot for each version.

A version is one file that is created only if it isn't there, so of two writers of one version one wins and the other is told.
Each snapshot holds a hash of its body. The newest version counts; one that is broken, or whose rules are refused now, is left
out, and where none is whole the built-in rules count. The newest `MOST_VERSIONS` are kept. Files are reached as Spark reaches
them, so the folder may be on any store that the session knows.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from veilspark.plans.rules import MOST_VERSIONS, RuleSet


class Conflict(RuntimeError):
    """Another writer has saved this version."""


def snapshot(rules: RuleSet) -> str:
    """A rule set's settings as JSON with their hash: what is switched off, the lists, the custom rules."""
    body = json.dumps({"version": rules.version, "disabled": sorted(rules.disabled), "black": list(rules.blacklist), "white": list(rules.whitelist), "custom": json.loads(rules.exported())}, ensure_ascii=False, sort_keys=True)
    return json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body})


def restored(text: str) -> RuleSet | None:
    """The rule set of a snapshot; None if it is broken."""
    try:
        held = json.loads(text)
        if hashlib.sha256(held["body"].encode()).hexdigest() != held["sha256"]:
            return None
        x = json.loads(held["body"])
        base = RuleSet()
        base = base.imported(json.dumps(x["custom"])) if x["custom"] else base
        base = base.with_lists(x["black"], x["white"])
        return replace(base, version=int(x["version"]), disabled=frozenset(x["disabled"]) & {r.rule_id for r in base.rules})
    except (ValueError, KeyError, TypeError):
        return None


class Settings:
    """The settings in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The saved versions, the newest first."""
        at = self._path(self.folder)
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"rules-v(\d+)\.json", n))), reverse=True)

    def _file(self, version: int) -> object:
        return self._path(f"{self.folder}/rules-v{version}.json")

    def save(self, rules: RuleSet) -> None:
        """Saves a version; a Conflict if it, or a newer one, is there already."""
        newest = next(iter(self.versions()), -1)
        if newest >= rules.version:
            raise Conflict(f"version {newest} is saved already")
        try:
            out = self._fs.create(self._file(rules.version), False)
        except Exception as e:
            if self._fs.exists(self._file(rules.version)):
                raise Conflict(f"version {rules.version} is saved already") from e
            raise
        try:
            out.write(bytearray(snapshot(rules).encode()))
        finally:
            out.close()
        for old in self.versions()[MOST_VERSIONS:]:
            self._fs.delete(self._file(old), False)

    def load(self, version: int | None = None) -> RuleSet:
        """The newest whole version, or the one asked for (a ValueError if it isn't whole); the built-in rules if nothing is saved."""
        for v in self.versions() if version is None else [version]:
            if self._fs.exists(self._file(v)):
                text = self.spark.read.text(str(self._file(v).toString()), wholetext=True).collect()  # one file of settings
                if text and (rules := restored(text[0].value)) is not None:
                    return rules
        if version is not None:
            raise ValueError(f"version {version} isn't there, or is broken")
        return RuleSet()

    def roll_back(self, version: int) -> RuleSet:
        """Saves an earlier version's settings as the newest version."""
        rules = replace(self.load(version), version=max(self.versions()) + 1)
        self.save(rules)
        return rules

    def to_dataframe(self) -> DataFrame:
        """The kept versions as a table: version, whole, disabled, black, white, custom (how many of each)."""
        rows = []
        for v in self.versions():  # `MOST_VERSIONS` at most
            text = self.spark.read.text(self._file(v).toString(), wholetext=True).collect()
            r = restored(text[0].value) if text else None
            rows.append((v, r is not None, *((len(r.disabled), len(r.blacklist), len(r.whitelist), len(r.custom)) if r else (None,) * 4)))
        return self.spark.createDataFrame(rows, "version long, whole boolean, disabled int, black int, white int, custom int")
