"""Posting classifiers: ordered rules as CASE expressions over short-circuited patterns."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.text import (
    UNICODE,
    col,
    contains_any,
    contains_whole_word,
    first_match,
    fold_umlauts,
    has_any,
    let,
    literal,
    text_or_blank,
    utrim,
)


def location_zone(
    location: Column | str,
    tiers: Sequence[tuple[str, Sequence[str]]] = rules.ZONE_TIERS,
    whole_word: bool = False,
) -> Column:
    """Label of the first tier with a place named in the text."""

    def zone(folded: Column) -> Column:
        def test(places: Sequence[str]) -> Column:
            return contains_whole_word(folded, *places) if whole_word else contains_any(folded, places)

        return first_match(((test(p), label) for label, p in tiers), rules.ZONE_DEFAULT)

    return let(fold_umlauts(location), zone)


def zone_rank(zone: Column | str, ranking: Sequence[str] = rules.ZONE_RANKING) -> Column:
    return first_match(((col(zone) == z, i) for i, z in enumerate(ranking)), len(ranking) - 1)


def is_in_region(
    location: Column | str,
    words: Sequence[str] = rules.REGION_CITIES + rules.REGION_STATES,
) -> Column:
    """Whether a city or state of the region is named; blank is false."""
    return contains_any(fold_umlauts(location), words)


# Label, alternative patterns, and for each pattern a word that any match of it contains.
Skill = tuple[str, Sequence[str], Sequence[str]]


def _literal_first(pattern: str) -> str:
    """A single whole word, written so that the search starts from its letters."""
    word = re.fullmatch(r"\\b([a-z0-9]+)\\b", pattern)
    return rf"{word[1]}(?<!\w{word[1]})\b" if word else pattern


def _hit(text: Column, pattern: str, words: Sequence[str]) -> Column:
    """Regular expression behind a byte search that skips it for most rows."""
    return has_any(text, words) & text.rlike(UNICODE + _literal_first(pattern))


def _any_hit(text: Column, cases: Iterable[tuple[str, Sequence[str]]]) -> Column:
    return functools.reduce(operator.or_, (_hit(text, p, words) for p, words in cases))


def extract_skills(
    description: Column | str,
    skills: Sequence[Skill] = rules.CORE_SKILLS + rules.SUPPORTING_SKILLS,
) -> Column:
    """Labels of the skills found, in dictionary order. Each pattern is matched once per row;
    counts follow from the labels (`label_hits`), which are unique in a dictionary."""

    def labels(text: Column) -> Column:
        found = (
            F.when(_any_hit(text, ((p, [w]) for p, w in zip(patterns, words, strict=True))), label)
            for label, patterns, words in skills
        )
        return F.array_compact(F.array(*found))

    return let(F.lower(text_or_blank(description)), labels)


def label_hits(labels: Column | str, skills: Sequence[Skill]) -> Column:
    """How many of the labels found belong to a dictionary."""
    return F.size(F.array_intersect(col(labels), F.expr(literal(s[0] for s in skills))))


def german_level(
    description: Column | str,
    required: Sequence[tuple[str, Sequence[str]]] = rules.GERMAN_REQUIRED,
    preferred: Sequence[tuple[str, Sequence[str]]] = rules.GERMAN_PREFERRED,
) -> Column:
    def level(text: Column) -> Column:
        return (
            F.when(_any_hit(text, required), "required")
            .when(_any_hit(text, preferred), "preferred")
            .otherwise("not_required")
        )

    return let(F.lower(text_or_blank(description)), level)


def is_excluded_title(
    title: Column | str, patterns: Sequence[tuple[str, Sequence[str]]] = rules.EXCLUDED_TITLES
) -> Column:
    """Whether any pattern matches."""
    pattern = "|".join(p for p, _ in patterns)
    words = [w for _, ws in patterns for w in ws]
    heading = F.lower(text_or_blank(title))
    return let(heading, lambda t: contains_any(t, words) & t.rlike(UNICODE + pattern))


def relevance_from_hits(excluded: Column, core_hits: Column, supporting_hits: Column) -> Column:
    """struct(label, score) out of the number of core and supporting skills."""
    label = (
        F.when(excluded, "non_relevant")
        .when(core_hits >= 1, "high_relevant")
        .when(supporting_hits >= rules.MIN_SUPPORTING, "relevant")
        .otherwise("non_relevant")
    )
    score = (core_hits * rules.CORE_WEIGHT + supporting_hits).cast("double")
    return F.struct(
        label.alias("label"),
        F.when(label == "non_relevant", F.lit(0.0)).otherwise(score).alias("score"),
    )


def relevance(
    title: Column | str,
    description: Column | str,
    core: Sequence[Skill] = rules.CORE_SKILLS,
    supporting: Sequence[Skill] = rules.SUPPORTING_SKILLS,
) -> Column:
    """struct(label, score): title exclusion first, then weighted skill hits."""
    labels = extract_skills(description, (*core, *supporting))
    found = F.struct(
        is_excluded_title(title).alias("excluded"),
        let(labels, lambda x: F.struct(label_hits(x, core).alias("core"),
                                       label_hits(x, supporting).alias("supporting"))).alias("hits"),
    )
    return let(
        found,
        lambda x: relevance_from_hits(x["excluded"], x["hits"]["core"], x["hits"]["supporting"]),
    )


def keep_title(title: Column | str, words: Sequence[str] = rules.ROLE_WORDS) -> Column:
    return contains_any(F.lower(col(title)), words)


def it_related(title: Column | str, keyword: Column | str | None = None) -> Column:
    """"yes" or "no": deny phrases, allow phrases, whole words, then the search keyword."""
    searched = F.lower(utrim(text_or_blank(keyword))) if keyword is not None else F.lit("")

    def signal(text: Column) -> Column:
        words = contains_whole_word(text, *rules.KEYWORD_SIGNAL_WORDS)
        return contains_any(text, rules.KEYWORD_SIGNALS) | words

    def label(heading: Column) -> Column:
        return (
            F.when(contains_any(heading, rules.NON_IT_PHRASES), "no")
            .when(contains_any(heading, rules.IT_PHRASES), "yes")
            .when(contains_whole_word(heading, *rules.IT_WORDS), "yes")
            .when(contains_any(heading, rules.KEYWORD_TITLE_WORDS) & let(searched, signal), "yes")
            .otherwise("no")
        )

    return let(F.lower(utrim(text_or_blank(title))), label)


def parse_scraped(value: Column | str) -> Column:
    """Minute-precision text as a timestamp; null if blank or malformed."""
    squeezed = F.regexp_replace(utrim(value), r"(?U)\s+", " ")
    return F.try_to_timestamp(squeezed, F.lit("yyyy-M-d H:m"))


def visit_status(
    pending: Column | str,
    message: Column | str,
    connect: Column | str,
    follow: Column | str,
    sent: Column | str | None = None,
    mode: str = "connect_or_follow",
    states: int = 5,
) -> Column:
    """Outcome of a recorded profile visit.

    `sent` says whether a request went through after the connect control was used; without it the
    control alone decides. With `states=3` pending and connected profiles count as visited only,
    and the follow control is tried in either mode.
    """
    pending, message, connect, follow = (col(c) for c in (pending, message, connect, follow))
    connected = message & ~connect & ~follow
    accepted = connect if sent is None else connect & col(sent)
    may_connect = F.lit(mode in ("connect", "connect_or_follow"))
    may_follow = F.lit(states == 3 or mode in ("follow", "connect_or_follow"))
    return (
        F.when(pending, "visited_only" if states == 3 else "already_pending")
        .when(connected, "visited_only" if states == 3 else "already_connected")
        .when(may_connect & accepted, "connect")
        .when(may_follow & follow, "follow")
        .otherwise("visited_only")
    )
