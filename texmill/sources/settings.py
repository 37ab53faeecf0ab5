"""Settings, glossaries, examples and rules from files, on the driver; tables where they are data."""

from __future__ import annotations

import copy
import json
import logging
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.operators import glossary

log = logging.getLogger(__name__)
DEFAULTS: dict = {
    "llm": {"sdk": None, "models": "offline", "key_variable": None, "endpoint": None, "temperature": 0.1},
    "compilation": {"timeout": 120},
    "fonts": {"main": None, "sans": None, "mono": None, "auto_detect": True},
    "translation": {"custom_system_prompt": None, "examples_path": None, "batch_short_threshold": 300, "batch_max_chars": 2000},
    "parser": {"extra_protected_environments": []},
}
# Font families in groups that fit together, best first.
FONT_GROUPS = (
    {"main": ["Noto Serif CJK SC", "Noto Serif CJK"], "sans": ["Noto Sans CJK SC", "Noto Sans CJK"], "mono": ["Noto Sans Mono CJK SC", "Noto Sans Mono CJK"]},
    {"main": ["Source Han Serif SC", "Source Han Serif"], "sans": ["Source Han Sans SC", "Source Han Sans"], "mono": ["Source Han Sans HW SC", "Source Han Sans HW"]},
    {"main": ["Songti SC", "STSong"], "sans": ["PingFang SC", "STHeiti"], "mono": ["STFangsong"]},
    {"main": ["SimSun", "SongTi"], "sans": ["SimHei", "Microsoft YaHei"], "mono": ["FangSong", "KaiTi"]},
    {"main": ["FandolSong"], "sans": ["FandolHei"], "mono": ["FandolKai"]},
)
EXAMPLES = [{"source": "We train the model for ten epochs.", "target": "[translated] We train the model for ten epochs."}]
RULES = "ord int, id string, description string, severity string, pattern string, replacement string, trigger string"


def deep_merge(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def _read(path: str | None):
    """A JSON or YAML file's content; None if there is none or it can't be read."""
    if not path or not Path(path).exists():
        return None
    text = Path(path).read_text(encoding="utf-8")
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            log.warning("%s is not JSON, and YAML can't be read here", path)
            return None
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as error:
            log.warning("%s: %s", path, error)
            return None


def load_settings(path: str | None = None, **flags) -> dict:
    """Defaults, then the file, then flags of the llm section; the first of several models counts."""
    out = deep_merge(DEFAULTS, _read(path) or {})
    out["llm"] |= {k: v for k, v in flags.items() if v is not None}
    models = out["llm"]["models"]
    if isinstance(models, list):
        if not models:
            raise ValueError("no model is named")
        out["llm"]["models"] = models[0]
    if out["llm"]["sdk"] is not None and out["llm"]["sdk"] not in ("openai", "openai-coding", "anthropic", "anthropic-coding", "ark", "bailian", "http", "offline"):
        raise ValueError(f"unknown sdk {out['llm']['sdk']!r}")
    return out


def coerce(value: str):
    """A command-line value as bool, int, float or string."""
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def set_value(path: str, dotted: str, value: str) -> dict:
    """Set one key of a settings file."""
    held = _read(path) or {}
    at = held
    *parents, last = dotted.split(".")
    for p in parents:
        at = at.setdefault(p, {})
    at[last] = coerce(value)
    Path(path).write_text(json.dumps(held, indent=2, ensure_ascii=False), encoding="utf-8")
    return held


def load_glossary(spark: SparkSession, base: dict | str | None, user: dict | str | None = None) -> DataFrame:
    """The base glossary with the user's entries over it."""
    tables = [spark.createDataFrame(glossary.rows_of(_read(g) if isinstance(g, str) else g or {}), glossary.COLUMNS) for g in (base, user)]
    return glossary.merged(*tables).orderBy("of", "ord").drop("of")


def load_examples(spark: SparkSession, path: str | None = None) -> DataFrame:
    """ord, source, target: the built-in examples, then those of a list or of an object's examples."""
    more = _read(path)
    more = more.get("examples", []) if isinstance(more, dict) else more or []
    rows = [(k, e["source"], e["target"]) for k, e in enumerate([*EXAMPLES, *(e for e in more if isinstance(e, dict) and {"source", "target"} <= e.keys())])]
    return spark.createDataFrame(rows, "ord int, source string, target string")


def rule_list(path: str | None) -> list[dict]:
    """Rules of a list or of an object's rules; one without id, description or a valid pattern is left out."""
    held = _read(path)
    held = held.get("rules", []) if isinstance(held, dict) else held or []
    out = []
    for r in held:
        if isinstance(r, dict) and all(isinstance(r.get(k), str) for k in ("id", "description", "pattern")):
            try:
                re.compile(r["pattern"])
            except re.error as error:
                log.warning("rule %s: %s", r["id"], error)
                continue
            out.append({"severity": "warning", "replacement": None, "trigger": None, **{k: r[k] for k in ("id", "description", "pattern", "severity", "replacement", "trigger") if k in r}})
        else:
            log.warning("not a rule: %r", r)
    return out


def load_rules(spark: SparkSession, path: str | None) -> DataFrame:
    return spark.createDataFrame([(k, r["id"], r["description"], r["severity"], r["pattern"], r["replacement"], r["trigger"]) for k, r in enumerate(rule_list(path))], RULES)


def pick_fonts(fonts: DataFrame) -> DataFrame:
    """main, sans, mono of installed fonts (family): all from the first group that has a main font.

    A family fits a name that it holds in any case; earlier names win, then the first family by name. Sans falls back
    on main and mono on sans; without any group the names of the first one stand.
    """
    rows = [(g, role, k, name.lower()) for g, of in enumerate(FONT_GROUPS) for role, names in of.items() for k, name in enumerate(names)]
    wanted = fonts.sparkSession.createDataFrame(rows, "g int, role string, rank int, wanted string")  # a fixed list
    best = fonts.join(F.broadcast(wanted), F.contains(F.lower("family"), F.col("wanted"))).groupBy("g", "role").agg(F.min_by("family", F.struct("rank", "family")).alias("family"))
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("family")))
    groups = best.groupBy("g").agg(of("main").alias("main"), of("sans").alias("sans"), of("mono").alias("mono")).where("main is not null")
    chosen = groups.agg(F.min_by(F.struct("main", "sans", "mono"), "g").alias("x")).select("x.*")
    first = {role: names[0] for role, names in FONT_GROUPS[0].items()}
    sans = F.coalesce("sans", "main")
    found = F.col("main").isNotNull()
    return chosen.select(F.coalesce("main", F.lit(first["main"])).alias("main"), F.when(found, sans).otherwise(first["sans"]).alias("sans"), F.when(found, F.coalesce("mono", sans)).otherwise(first["mono"]).alias("mono"))
