"""Levels of words that are not listed but are built from listed words.

A word is resolved by the first rule that succeeds; the level of a compound is the highest level of
its parts. Rules that strip something from the front or the back ask for the level of what is left,
so they chain. What can be left is known beforehand: the front can only lose characters of the
leading run of prefix, numeral or ordinal characters, the back only trailing suffix characters. The
grid of these remainders is small, and one pass over it from the shortest end to the whole word
replaces recursion.

Every distinct word lists the strings its rules may look up, one equi-join with the word list finds
their levels, and the grid is folded with column expressions. Nothing is collected or iterated on
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lexfreq import fixed_values as V
from lexfreq.functions.text import characters


@dataclass(frozen=True)
class RuleSet:
    """Character classes of one language. Empty classes switch their rules off."""

    ordinal: str = ""
    numerals: str = ""
    verbs: str = ""
    pronouns: str = ""
    measures: str = ""
    functions: str = ""
    name_risk: str = ""
    surnames: str = ""
    suffixes: str = ""
    silent_suffix: str = ""
    prefixes: str = field(init=False, default="")

    def __post_init__(self):
        joined = self.functions + self.verbs + self.pronouns + self.measures + self.name_risk
        object.__setattr__(self, "prefixes", joined)

    @property
    def front(self) -> str:
        return self.ordinal + self.numerals + self.prefixes

    @property
    def back(self) -> str:
        return self.suffixes + self.silent_suffix


HAN_RULES = RuleSet(
    ordinal=V.ORDINAL_MARK, numerals=V.NUMERALS, verbs=V.VERB_PREFIXES, pronouns=V.PRONOUN_PREFIXES,
    measures=V.MEASURE_PREFIXES, functions=V.FUNCTION_PREFIXES, name_risk=V.NAME_RISK_PREFIXES,
    surnames=V.SURNAMES, suffixes=V.ASPECT_SUFFIXES, silent_suffix=V.SILENT_SUFFIX)

# Doubled forms and two listed words side by side need no character class.
PLAIN_RULES = RuleSet()


def _run(text: Column, chars: str, at_end: bool = False, lead: str = "") -> Column:
    """The run of class characters at one end of the text ('' when there is none)."""
    if not chars:
        return F.lit("")
    return F.regexp_extract(text, rf"[{chars}]+\z" if at_end else rf"\A{lead}[{chars}]+", 0)


def _in(char: Column, chars: str) -> Column:
    return F.contains(F.lit(chars), char) & (char != "") if chars else F.lit(False)


def _is_double(text: Column) -> Column:
    return (F.length(text) == 2) & (F.substr(text, F.lit(1), F.lit(1)) == F.substr(text, F.lit(2), F.lit(1)))


def _is_aabb(text: Column) -> Column:
    def at(i):
        return F.substr(text, F.lit(i), F.lit(1))
    return (F.length(text) == 4) & (at(1) == at(2)) & (at(3) == at(4))


def _aabb_base(text: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), F.lit(1)), F.substr(text, F.lit(3), F.lit(1)))


def _left(text: Column, n: Column) -> Column:
    return F.substr(text, F.lit(1), n)


def _from(text: Column, start: Column) -> Column:
    """Everything from the 0-based start."""
    return F.substr(text, start + 1, F.length(text))


def _splits(text: Column) -> Column:
    """Left lengths at which both sides have two characters or more, and no more than the longest listed word."""
    low = F.greatest(F.lit(2), F.length(text) - F.col("longest"))
    high = F.least(F.length(text) - 2, F.col("longest"))
    return F.when((F.length(text) >= 4) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


class _Grid:
    """The remainders of `word`: `front` characters gone from the front, `back` from the back.

    Cells are numbered so that every cell comes after the cells its rules ask for.
    """

    def __init__(self, rules: RuleSet, word: Column):
        self.rules, self.word = rules, word
        self.lead = F.length(_run(word, rules.front))
        self.trail = F.length(_run(word, rules.back, at_end=True))

    def cells(self, detail: bool = False) -> Column:
        """The remainders in order; with detail also what several rules ask about each."""
        def cell(front: Column, back: Column) -> Column:
            text = F.substr(self.word, front + 1, F.length(self.word) - front - back)
            return F.struct(front.alias("front"), back.alias("back"), text.alias("text"))

        def detailed(c: Column) -> Column:
            text, rules = c["text"], self.rules
            ordinal = _run(text, rules.numerals, lead=rules.ordinal) if rules.ordinal else F.lit("")
            return F.struct(
                c["front"].alias("front"), c["back"].alias("back"), text.alias("text"),
                F.length(text).alias("size"), F.left(text, F.lit(1)).alias("first"),
                F.right(text, F.lit(1)).alias("last"), ordinal.alias("ordinal"),
                _run(text, rules.numerals).alias("number"))

        grid = F.flatten(F.transform(
            F.sequence(F.col("trail"), F.lit(0), F.lit(-1)),
            lambda back: F.transform(F.sequence(F.col("lead"), F.lit(0), F.lit(-1)), lambda front: cell(front, back))))
        return F.transform(grid, detailed) if detail else grid

    @staticmethod
    def index(front: Column, back: Column) -> Column:
        return (F.col("trail") - back) * (F.col("lead") + 1) + F.col("lead") - front


def _probes(text: Column, rules: RuleSet) -> Column:
    """Strings a remainder may look up, besides single class characters."""
    none = F.array().cast("array<string>")
    single = F.when(F.length(text) == 1, F.array(F.concat(text, text))).otherwise(none)
    double = F.when(_is_double(text), F.array(F.substr(text, F.lit(1), F.lit(1)))).otherwise(none)
    aabb = F.when(_is_aabb(text), F.array(_aabb_base(text))).otherwise(none)
    halves = F.flatten(F.transform(_splits(text), lambda i: F.array(_left(text, i), _from(text, i))))
    parts = [F.array(text), single, double, aabb, halves]
    if rules.ordinal and rules.numerals:
        parts.append(F.array(_run(text, rules.numerals, lead=rules.ordinal)))
    return F.concat(*parts)


def _highest(levels: Column) -> Column:
    """Maximum of an array of levels, null when any is unknown."""
    return F.aggregate(levels, F.lit(0), lambda top, level: F.when(
        top.isNotNull() & level.isNotNull(), F.greatest(top, level)))


def _cell_level(cell: Column, resolved: Column, rules: RuleSet) -> Column:
    """Level of one remainder, given the levels of the remainders before it."""
    text, size, first, last = cell["text"], cell["size"], cell["first"], cell["last"]

    def listed(part: Column) -> Column:
        return F.try_element_at(F.col("known"), part)

    def rest(skip: Column, drop: Column) -> Column:
        return F.get(resolved, _Grid.index(cell["front"] + skip, cell["back"] + drop))

    def characters_of(run: Column) -> Column:
        return F.transform(characters(run), listed)

    zero, one = F.lit(0), F.lit(1)
    long_rules: list[Column] = []
    if rules.ordinal and rules.numerals:
        run = cell["ordinal"]
        base = F.coalesce(listed(run), _highest(characters_of(run)))
        tail = F.when(F.length(run) == size, F.array(base)).otherwise(F.array(base, rest(F.length(run), zero)))
        long_rules.append(F.when(run != "", _highest(tail)))
    long_rules.append(F.when(_is_double(text), listed(first)))
    long_rules.append(F.when(_is_aabb(text), listed(_aabb_base(text))))
    if rules.silent_suffix:
        long_rules.append(F.when(last == rules.silent_suffix, rest(zero, one)))
    if rules.numerals:
        run = cell["number"]
        tail = F.when(F.length(run) < size, F.array(rest(F.length(run), zero))).otherwise(
            F.array().cast("array<int>"))
        long_rules.append(F.when(run != "", _highest(F.concat(characters_of(run), tail))))
    if rules.prefixes:
        long_rules.append(F.when(_in(first, rules.prefixes) & ~_is_name(text, rules),
                                 _highest(F.array(listed(first), rest(one, zero)))))
    if rules.suffixes:
        long_rules.append(F.when(_in(last, rules.suffixes), _highest(F.array(rest(zero, one), listed(last)))))
    pairs = F.transform(_splits(text), lambda i: _highest(F.array(listed(_left(text, i)), listed(_from(text, i)))))
    long_rules.append(F.get(F.filter(pairs, lambda v: v.isNotNull()), zero))
    return F.coalesce(listed(text), F.when(size == 1, listed(F.concat(text, text)))
                      .when(size > 1, F.coalesce(*long_rules)))


def _is_name(text: Column, rules: RuleSet) -> Column:
    """A title character in front of a lone surname."""
    if not (rules.name_risk and rules.surnames):
        return F.lit(False)
    return ((F.length(text) == 2) & _in(F.substr(text, F.lit(1), F.lit(1)), rules.name_risk)
            & _in(F.substr(text, F.lit(2), F.lit(1)), rules.surnames))


def _pattern(word: Column, rules: RuleSet) -> Column:
    """The name of the rule family a resolved word belongs to. For reports only."""
    size = F.length(word)
    first, last = F.substr(word, F.lit(1), F.lit(1)), F.substr(word, size, F.lit(1))

    def listed(part: Column) -> Column:
        return F.try_element_at(F.col("known"), part).isNotNull()

    def rest(skip: Column, drop: Column) -> Column:
        return F.get(F.col("levels"), _Grid.index(skip, drop)).isNotNull()

    zero, one = F.lit(0), F.lit(1)
    label = F.when(size == 1, V.PATTERN_SINGLE)
    if rules.ordinal and rules.numerals:
        label = label.when(_run(word, rules.numerals, lead=rules.ordinal) != "", V.PATTERN_ORDINAL)
    label = label.when(_is_double(word) & listed(first), V.PATTERN_REDUPLICATION)
    label = label.when(_is_aabb(word) & listed(_aabb_base(word)), V.PATTERN_AABB)
    if rules.silent_suffix:
        label = label.when((last == rules.silent_suffix) & rest(zero, one), V.PATTERN_ERHUA)
    if rules.numerals:
        run = F.length(_run(word, rules.numerals))
        label = label.when(run == size, V.PATTERN_NUMERAL)
        label = label.when((run > 0) & rest(run, zero), V.PATTERN_NUMERAL_UNIT)
    if rules.prefixes:
        open_prefix = _in(first, rules.prefixes) & ~_is_name(word, rules) & rest(one, zero)
        label = label.when(open_prefix & _in(first, rules.verbs), V.PATTERN_VERB)
        label = label.when(open_prefix & _in(first, rules.pronouns), V.PATTERN_PRONOUN)
        label = label.when(open_prefix & _in(first, rules.measures), V.PATTERN_MEASURE)
        label = label.when(open_prefix, V.PATTERN_FUNCTION)
    if rules.suffixes:
        label = label.when(_in(last, rules.suffixes) & rest(zero, one), V.PATTERN_ASPECT)
    return label.otherwise(V.PATTERN_TWO_WORDS)


def resolve_words(words: DataFrame, wordlist: DataFrame, rules: RuleSet = HAN_RULES) -> DataFrame:
    """words(word) -> (word, decomposed_level, match_pattern) for the unlisted words that resolve."""
    listed = (wordlist.filter(F.col("word_level").isNotNull())
              .groupBy(F.col("word").alias("part")).agg(F.min("word_level").cast("int").alias("level")))
    unlisted = (words.select("word").distinct()
                .join(listed.select(F.col("part").alias("word")), "word", "left_anti")
                .filter(F.col("word") != ""))
    grid = _Grid(rules, F.col("word"))
    longest = F.coalesce(listed.agg(F.max(F.length("part"))).scalar(), F.lit(0)).alias("longest")
    shaped = unlisted.select("word", grid.lead.alias("lead"), grid.trail.alias("trail"), longest)

    asked = F.flatten(F.transform(grid.cells(), lambda c: _probes(c["text"], rules)))
    if rules.front or rules.back:
        class_chars = f"[{rules.front}{rules.back}]"
        asked = F.concat(asked, F.filter(characters(F.col("word")), lambda c: c.rlike(class_chars)))
    found = (shaped
             .select("word", "longest", F.explode(F.array_distinct(asked)).alias("part"))
             .filter((F.col("part") != "") & (F.length("part") <= F.col("longest")))
             .join(listed, "part")
             .groupBy("word", "longest")
             .agg(F.map_from_entries(F.collect_list(F.struct("part", "level"))).alias("known")))
    # A word without any known part cannot resolve, so it is not needed again.
    folded = (found
              .select("word", "longest", "known", grid.lead.alias("lead"), grid.trail.alias("trail"))
              .withColumn("levels", F.aggregate(
                  grid.cells(detail=True), F.array().cast("array<int>"),
                  lambda resolved, cell: F.concat(resolved, F.array(_cell_level(cell, resolved, rules)))))
              .withColumn("decomposed_level", F.element_at("levels", -1)))
    return (folded.filter(F.col("decomposed_level").isNotNull())
            .select("word", "decomposed_level", _pattern(F.col("word"), rules).alias("match_pattern")))
