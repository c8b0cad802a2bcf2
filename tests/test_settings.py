"""Settings saved by versions: one writer wins, the last twenty stay, a broken one is passed over."""

from dataclasses import replace

import pytest

from veilspark.plans.rules import RuleSet
from veilspark.plans.settings import Conflict, Settings, restored, snapshot


def test_versions(spark, tmp_path):
    s = Settings(spark, str(tmp_path / "rules"))
    assert s.versions() == [] and s.load().version == RuleSet().version and s.to_dataframe().count() == 0
    one = RuleSet().with_custom("case", "legal", 50, r"CASE-\d{4}").with_lists(black=["Acme $1 'x'"], white=["ok"]).disable("URL")
    s.save(one)
    got = s.load()
    assert (got.version, got.disabled, got.blacklist, got.whitelist, [(r.rule_id, r.pattern, r.priority) for r in got.custom]) == (one.version, one.disabled, one.blacklist, one.whitelist, [("CUSTOM_CASE", r"CASE-\d{4}", 50)])
    with pytest.raises(Conflict):
        Settings(spark, str(tmp_path / "rules")).save(replace(one, disabled=frozenset()))
    assert s.load().disabled == one.disabled
    for v in range(one.version + 1, one.version + 25):
        s.save(replace(one, version=v))
    assert len(s.versions()) == 20 and s.versions()[0] == one.version + 24
    (tmp_path / "rules" / f"rules-v{one.version + 24}.json").write_text("{broken")
    (tmp_path / "rules" / f".rules-v{one.version + 24}.json.crc").unlink(missing_ok=True)
    assert s.load().version == one.version + 23
    back = s.roll_back(one.version + 10)
    assert back.version == one.version + 25 == s.load().version and back.blacklist == one.blacklist
    with pytest.raises(ValueError, match="broken"):
        s.load(one.version + 24)
    table = {r.version: r for r in s.to_dataframe().collect()}
    assert table[back.version].custom == 1 and not table[one.version + 24].whole


def test_snapshots_tell_what_is_broken():
    text = snapshot(RuleSet().with_lists(black=["a"]))
    assert restored(text).blacklist == ("a",) and restored(text.replace('\\"a\\"', '\\"b\\"')) is None and restored("") is None and restored("[]") is None
