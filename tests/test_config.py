import pytest

from quorate.plans import config


def test_lookups():
    assert config.datasets("cc") == ("aggrefact_xsum", "aggrefact_wice", "aggrefact_cnn", "aggrefact_expertqa") and config.datasets("medhallu") == ("medhallu",)
    assert config.condition_of("aggrefact_cnn") == "claimcheck" and config.condition_of("ragtruth") == "def_on" and config.frame_of("factscore") == "qa"
    with pytest.raises(ValueError):
        config.datasets("x")


def test_arm_sets():
    assert config.conditions_for("contrast", "aggrefact_cnn") == ("def_on",) and config.permitted("main", "ragtruth", "def_on, def_on") == ("def_on",)
    for bad in (("contrast", "ragtruth", "def_on"), ("main", "ragtruth", "claimcheck"), ("main", "ragtruth", ""), ("none", "ragtruth", "def_on")):
        with pytest.raises(ValueError):
            config.permitted(*bad)


def test_judges():
    assert [j.key for j in config.select("autoj, api, autoj")] == ["autoj", "sonnet"] and len(config.select("all")) == 8
    with pytest.raises(ValueError):
        config.select("who")
    keys = {j.key: j for j in config.JUDGES}
    assert config.expected_arms(keys["autoj"], "aggrefact_cnn") == ("claimcheck",) and config.expected_arms(keys["sonnet"], "aggrefact_cnn", True) == ("def_on",)
    assert config.expected_arms(keys["minicheck_ft5"], "medhallu") == ("claimcheck",)
    assert config.tag_judge("sonnet_defon").key == "sonnet" and config.tag_judge("pt_autoj").key == "autoj" and config.tag_judge("zzz") is None
    assert config.roster_matches(["a", "b"], ["b", "a"]) and not config.roster_matches(["a"], ["a", "b"])


def test_lifecycle(monkeypatch):
    f = config.deprecated("use g")(lambda: 1)
    with pytest.warns(DeprecationWarning):
        assert f() == 1
    monkeypatch.setenv("QUORATE_SILENCE_DEPRECATED", "1")
    assert f() == 1
    with pytest.raises(RuntimeError):
        config.require(False, "no")
