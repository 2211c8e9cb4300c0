"""Names of people and organisations: stop words, overlap with earlier spans, and models that plug in.

A model is a callable that takes a list of texts and gives, for each, tuples (start, end, label, score). It is built once in each Python worker. No model is shipped; the
rules here (surnames with initials, and patronymics) are our own and claim no parity with any of them.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.folding import bind
from ..schema import NAMES, SPANS, span
from ..workers import reach_workers
from .merge import similar

log = logging.getLogger("spanveil")

# The words of the domain that never are names.
DOMAIN = tuple(
    """акт арендатор арендодатель аудитор внеплановый выписка гарантия глава далее договор договорной доначисленные заказчик исполнитель клиент контрагент минтруд минтранс
    настоящий оборудование организация основание пени плановый площадка подрядчик покупатель поставщик предмет предпрятие претензия применимый пункт раздел работа работник
    согласно спецификация статья сторона субисполнитель субподрядчик счет товар технический уполномоченный условие услуга""".split()
)
# General stop words of Russian.
GENERAL = tuple(
    """и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже
    или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под
    будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой хоть
    после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между""".split()
)
STOP = (*GENERAL, *DOMAIN)
#: Endings of the cases by the ending of the lemma; the first that fits counts.
ENDINGS = (
    (("ый", "ой"), ("ый", "ого", "ому", "ым", "ом", "ая", "ой", "ую", "ое", "ые", "ых", "ыми")),
    (("ий",), ("ий", "его", "ему", "им", "ем", "яя", "ая", "ей", "ую", "ее", "ие", "их", "ими")),
    (("ие",), ("ие", "ия", "ию", "ием", "ии", "ий", "иям", "иями", "иях")),
    (("ия",), ("ия", "ии", "ию", "ией", "ий", "иям", "иями", "иях")),
    (("ка", "га"), ("ка", "ки", "ке", "ку", "кой", "кам", "ками", "ках", "ок", "га", "ги", "ге", "гу", "гой", "гам", "гами", "гах")),
    (("а",), ("а", "ы", "е", "у", "ой", "", "ам", "ами", "ах")),
    (("я",), ("я", "и", "е", "ю", "ёй", "ей", "", "ям", "ями", "ях")),
    (("ель",), ("ель", "еля", "елю", "елем", "еле", "ели", "елей", "елям", "елями", "елях")),
    (("ок",), ("ок", "ка", "ку", "ком", "ке", "ки", "ков", "кам", "ками", "ках")),
    (("",), ("", "а", "у", "ом", "е", "ы", "и", "ов", "ам", "ами", "ах")),
)
TOKEN = r"(\p{L}[\p{L}\p{N}]*(?:-\p{L}+)*)"
FULL_SCORE, NAME_SCORE, ADDRESS_SCORE, SHORTEST = 0.8, 0.75, 0.8, 4
RULE = r"[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.|[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+(?:вич|вна|ична|вича|вны|ичны)(?![а-яё])"

Found = list[tuple[int, int, str, float]]
Model = Callable[[list[str]], list[Found]]
_MODELS: dict[Callable[[], Model], Model] = {}


def forms(lemma: str) -> set[str]:
    """Forms of a noun or adjective by the ending of its lemma: enough to know stop words again, no grammar."""
    for tails, endings in ENDINGS:
        tail = next((t for t in tails if lemma.endswith(t)), None)
        if tail is not None:
            stem = lemma[: len(lemma) - len(tail)]
            return {lemma, *(stem + e for e in endings if e[:1] == tail[:1] or len(tail) < 2 or tail[:1] not in "кг")}
    return {lemma}


def lemma_table(table: dict[str, str]) -> Callable[[Column], Column]:
    """Lemmas from a table of forms, as of a dictionary that the user has; any other word is its own lemma."""
    known = F.create_map(*[F.lit(x) for item in sorted(table.items()) for x in item])
    return lambda word: F.coalesce(F.element_at(known, F.lower(word)), F.lower(word))


def domain_lemmas(words: Iterable[str] = DOMAIN) -> Callable[[Column], Column]:
    """Lemmas of the forms of the domain words, by rule."""
    return lemma_table({form: word for word in words for form in forms(word)})


def stop_fragment(fragment: Column, stop: Iterable[str] = STOP, lemmas: Callable[[Column], Column] | None = None) -> Column:
    """Whether a fragment is made of stop words: all of them, one of at most two, or four fifths of a short one. Without words it is."""
    lemmas = lemmas or domain_lemmas()
    initial = lambda w: (F.length(w) == 1) & (w != F.lower(w))  # noqa: E731  a capital by itself is no word
    words = F.transform(F.regexp_extract_all(fragment, F.lit(TOKEN), F.lit(1)), lambda w: F.when(initial(w), w).otherwise(lemmas(w)))
    table = F.array(*[F.lit(w) for w in stop])
    hits = F.size(F.filter(words, lambda w: F.array_contains(table, w)))
    n = F.size(words)
    return (n == 0) | (hits == n) | ((n <= 2) & (hits >= 1)) | ((hits >= n * 0.8) & (F.length(fragment) < 24))


def rules() -> Model:
    rx = re.compile(RULE)
    return lambda texts: [[(m.start(), m.end(), "PERSON", NAME_SCORE) for m in rx.finditer(t or "")] for t in texts]


def model_spans(text: Column, build: Callable[[], Model], required: bool = True) -> Column:
    """array<SPAN> of a model, a batch at a time. A model that fails stops the query: texts that it has not searched would look like texts without names.

    So does one that can't be built, unless it is not required: then it gives no spans at all, and the workers' logs say so.
    """
    reach_workers()

    @F.pandas_udf("array<struct<start:int,end:int,label:string,score:double>>")
    def run(texts: pd.Series) -> pd.Series:
        if build not in _MODELS:
            try:
                _MODELS[build] = build()
            except Exception:
                if required:
                    raise
                log.warning("a model that is not required can't be built: %d texts are not searched by it", len(texts), exc_info=True)
                return pd.Series([[] for _ in texts], dtype=object)
        found = _MODELS[build]([t or "" for t in texts])
        return pd.Series([[dict(zip(("start", "end", "label", "score"), s, strict=True)) for s in own] for own in found], dtype=object)

    return F.transform(run(text), lambda s: span(s["start"], s["end"], s["label"], s["score"], NAMES))


def _fragment(text: Column, s: Column) -> Column:
    return text.substr(s["start"] + 1, s["end"] - s["start"])


def without_stop_words(text: Column, spans: Column) -> Column:
    return F.filter(spans, lambda s: ~stop_fragment(_fragment(text, s)))


def extracted_names(text: Column, names: Column, known: Column) -> Column:
    """Names that are no stop words, have at least four characters, begin with a letter, and are not near a known person."""

    def good(s: Column, people: Column) -> Column:
        piece = F.regexp_replace(_fragment(text, s), r"(?U)^\s+|\s+$", "")
        fits = (F.length(piece) >= SHORTEST) & piece.rlike(r"^\p{L}")
        return ~stop_fragment(_fragment(text, s)) & fits & ~F.exists(people, lambda p: similar(s, p))

    # Both arrays may come from Python workers, which lambdas can't call: they are bound before.
    both = F.struct(names.alias("names"), F.filter(known, lambda s: s["label"] == "PERSON").alias("people"))
    return bind(both, lambda x: F.filter(x["names"], lambda s: good(s, x["people"])))


def name_spans(
    text: Column, full: Callable[[], Model] | None = None, names: Callable[[], Model] | None = rules, addresses: Callable[[], Model] | None = None, required: bool = False
) -> list[Column]:
    """Spans of a full model, of a name extractor beside it, and of an address extractor; each may be None. The plans require what they are given; here it is asked for."""
    none = F.array().cast(SPANS)
    known = without_stop_words(text, model_spans(text, full, required)) if full else none
    out = [known]
    if names:
        out.append(extracted_names(text, model_spans(text, names, required), known))
    if addresses:
        out.append(without_stop_words(text, model_spans(text, addresses, required)))
    return out
