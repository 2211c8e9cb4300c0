"""Pattern bundles and settings: profiles, files, search order, validation."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field
from pathlib import Path

from .functions.dialect import Pattern, compile_pattern, python_flags

log = logging.getLogger(__name__)

NAMES = (
    "org_pattern", "role_named_pattern", "in_face_pattern", "subject_header_pattern", "email_pattern", "url_pattern", "inn_pattern", "ogrn_pattern",
    "kpp_pattern", "bik_pattern", "rs_pattern", "ks_pattern", "addr_window_pattern", "addr_street_pattern", "addr_house_pattern",
)

# The patterns, flags and keywords of the shipped profile.
SHIPPED = {
    "version": 1,
    "regex": {
        "org_pattern": r"""(?<!\w)(?:ООО|АО|ПАО|ЗАО|ОАО|ГУП|МУП|ИП|ФГБУ|АНО|НКО|ТСЖ|
            Общество\W{0,5}с\W{0,5}ограниченной\W{0,5}ответственностью|
            Акционерное\W{0,5}общество|
            Публичное\W{0,5}акционерное\W{0,5}общество|
            Закрытое\W{0,5}акционерное\W{0,5}общество)(?!\w)\W{0,5}[«"“„']?\s*[А-ЯЁA-Z0-9][^"»”\n]{1,200}[»"”']?""",
        "role_named_pattern": r"""\bдействующ(?:их|его|ей)\b
            (?:\s+совместно)?
            \s+на\s+основании
            \s+доверенност(?:и|ь)\b
            (?:
            \s*(?:№|N(?:o)?\.?)?\s*(?P<num>[A-Za-zА-Яа-я0-9\-/.]+))?(?:\s*от\s*(?P<date>\d{1,2}[./]\d{1,2}[./]\d{2,4})
            )?""",
        "in_face_pattern": r"в\s+лице\s+[^,\n]+?",
        "subject_header_pattern": "(?!)",
        "email_pattern": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        "url_pattern": r"(?:(?:https?|ftp)://)?(?:www\.)?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*)?",
        "inn_pattern": r"\b\d{10}\b|\b\d{12}\b",
        "ogrn_pattern": r"\b\d{13}\b",
        "kpp_pattern": r"\b\d{4}\d{2}\d{3}\b",
        "bik_pattern": r"\b\d{9}\b",
        "rs_pattern": r"\b\d{20}\b",
        "ks_pattern": r"\b\d{20}\b",
        "addr_window_pattern": r"""\b(?:
            г|город|рп|пгт|пос|пос[её]лок|дер|деревня|с|село|
            р-н|район|мо|муницип(?:алитет|альное[ \t]+образование)|
            ул|улица|пр-?т|просп(?:ект)?|пер|переулок|
            ш(?:оссе)?|шоссе|наб(?:ережная)?|пл(?:ощадь)?|проезд|
            б-?р|бульвар|тер(?:ритория)?|промзона|
            кв|квартира|лит|
            д\.?|дом|корп\.?|корпус|стр\.?|строение
            )\b.{50,100}?
            \b(?:
            г|город|рп|пгт|пос|пос[её]лок|дер|деревня|с|село|
            р-н|район|мо|муницип(?:алитет|альное[ \t]+образование)|
            ул|улица|пр-?т|просп(?:ект)?|пер|переулок|
            ш(?:оссе)?|шоссе|наб(?:ережная)?|пл(?:ощадь)?|проезд|
            б-?р|бульвар|тер(?:ритория)?|промзона|
            кв|квартира|лит|комн|
            д\.?|дом|корп\.?|корпус|стр\.?|строение
            )\b""",
        "addr_street_pattern": r"\b(ул\.?|улица|пр-?т|просп(?:ект)?|пер|переулок|ш(?:оссе)?|шоссе|наб\.?|набережная|пл\.?|площадь|проезд|б-?р|бульвар)\b",
        "addr_house_pattern": r"\b(д\.?|дом|корп\.?|корпус|стр\.?|строение)\b\s*\d+([/\-]\w+)?",
    },
    "flags": {
        "org_pattern": ["I", "U", "X"], "role_named_pattern": ["I", "U", "X"], "in_face_pattern": ["I", "U"], "subject_header_pattern": ["I", "M", "U"],
        "email_pattern": ["I", "U"], "url_pattern": ["I", "U"], "inn_pattern": ["U"], "ogrn_pattern": ["U"], "kpp_pattern": ["U"], "bik_pattern": ["U"],
        "rs_pattern": ["U"], "ks_pattern": ["U"], "addr_window_pattern": ["I", "U", "X", "S"], "addr_street_pattern": ["I", "U", "X"], "addr_house_pattern": ["I", "U", "X"],
    },
    "keywords": {"subject_keywords": ["(?!)"]},
}
# What the documented profile has instead.
DOCUMENTED = {
    "version": 1,
    "regex": SHIPPED["regex"] | {
        "org_pattern": r"""(?:ООО|АО|ПАО|ЗАО|ОАО|ГУП|МУП|ИП|ФГБУ|АНО|НКО|ТСЖ)\s+[«"']?[А-ЯЁA-Z0-9][^"»\n]{1,100}[»"']?""",
        "role_named_pattern": r"""именуем\w*\s+в\s+дальнейшем\s+[«"']?\s*([А-ЯЁA-Z][^»"\n]{1,40})[»"']?""",
        "in_face_pattern": r"в\s+лице\s+[^,\n]+?,\s*действующ\w*\s+на\s+основан\w+",
        "subject_header_pattern": r"(?im)^\s*(ПРЕДМЕТ\s+ДОГОВОРА|Предмет\s+договора)\s*$",
    },
    "flags": SHIPPED["flags"] | {"org_pattern": ["U"], "role_named_pattern": ["I", "U"], "in_face_pattern": ["I", "U"], "subject_header_pattern": ["I", "M", "U"]},
    "keywords": {"subject_keywords": ["обязуется", "предметом является", "оказать", "выполнить", "поставить"]},
}
PROFILES = {"shipped": SHIPPED, "documented": DOCUMENTED}


@dataclass(frozen=True)
class Bundle:
    """Compiled patterns; one that is None is off. A bundle travels in the plan, so a running query keeps its own."""

    patterns: dict[str, Pattern] = field(default_factory=dict)
    subject_keywords: tuple[str, ...] = ()

    def __getitem__(self, name: str) -> Pattern | None:
        return self.patterns.get(name)


def bundle(data: dict) -> Bundle:
    """Validate and compile; unknown top-level keys, flags and versions warn, unknown nested keys are ignored."""
    unknown = sorted(set(data) - {"version", "regex", "flags", "keywords"})
    if unknown:
        log.warning("unknown keys in the patterns: %s", ", ".join(unknown))
    if data.get("version", 1) != 1:
        log.warning("version %s of the patterns is not known; going on", data["version"])
    regex, flags, keywords = data.get("regex"), data.get("flags") or {}, data.get("keywords") or {}
    if not isinstance(regex, dict) or not isinstance(flags, dict) or not isinstance(keywords, dict):
        raise ValueError("patterns need a mapping 'regex', and mappings 'flags' and 'keywords' if they are there")
    patterns = {}
    for name in NAMES:
        if regex.get(name) is not None:
            own = flags.get(name) or []
            if python_flags(own)[1]:
                log.warning("unknown flags of %s: %s", name, ",".join(python_flags(own)[1]))
            patterns[name] = compile_pattern(name, regex[name], own)
    return Bundle(patterns, tuple(keywords.get("subject_keywords") or ()))


def read_file(path: str | Path) -> dict:
    """YAML or JSON, by its extension; an empty YAML file is an empty mapping."""
    suffix, text = Path(path).suffix.lower(), Path(path).read_text(encoding="utf-8")
    if suffix == ".json":
        return json.loads(text)
    if suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text) or {}
    raise ValueError(f"patterns can't be read from a {suffix or 'nameless'} file")


def resolve_path(explicit: str | None = None) -> tuple[str | None, str]:
    """Where patterns come from: the argument, the environment, ./config, or nowhere."""
    if explicit:
        return explicit, "EXPLICIT"
    for name in ("REDactor_PATTERNS", "REDACTOR_PATTERNS"):
        if os.environ.get(name):
            return os.environ[name], "ENV"
    for name in ("patterns.yaml", "patterns.json"):
        if (path := Path.cwd() / "config" / name).is_file():
            return str(path), "DEFAULT_PATH"
    return None, "FALLBACK"


def load_patterns(path: str | None = None, profile: str = "shipped") -> Bundle:
    """The bundle of the first file found, else of a built-in profile."""
    found, _ = resolve_path(path)
    return bundle(read_file(found) if found else PROFILES[profile])


@dataclass(frozen=True)
class Settings:
    enable_email_recognizer: bool = True
    enable_phone_recognizer: bool = True
    mask_style: str = "tag"


def load_settings() -> Settings:
    """REDACTOR_SETTINGS, ./config/settings.yaml or .json, else defaults; anything wrong gives defaults."""
    places = [os.environ.get("REDACTOR_SETTINGS"), *(Path.cwd() / "config" / f"settings.{x}" for x in ("yaml", "json"))]
    for place in places:
        if place and Path(place).is_file():
            try:
                data = read_file(place)
                return Settings(**{k: data[k] for k in Settings.__dataclass_fields__ if k in data})
            except (OSError, ValueError, TypeError, ImportError) as e:
                log.warning("settings in %s can't be used: %s", place, e)
                return Settings()
    return Settings()
