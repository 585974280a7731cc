"""Time expressions in a question as ranges of days around a given day.

A text is cut into tokens once: numbers, units, words that point to a time, marks. Each token has a kind, one letter,
and the kinds of a text are a string of as many letters. A period is a short sequence of kinds, so every question
about times is a question to that string; a period's days follow from the tokens it covers. Spark expressions throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that name numbers, places in a row, units (in days) and times.
NUMBERS = {"일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9, "십": 10}
ORDINALS = {"첫": 1, "둘": 2, "셋": 3, "넷": 4, "다섯": 5}
RECENT = "최근"
DAYS = {"일": 1, "주": 7, "주일": 7, "달": 30, "한달": 30, "개월": 30}

#: Kinds of words, a letter each. "일" is a unit and a number; "주일" is two tokens.
WORDS = {
    "R": [RECENT], "N": ["이번"], "P": ["지난"], "S": ["저번"], "B": ["전"], "X": ["다음"], "L": ["마지막"], "t": ["오늘"], "v": ["어제"],
    "o": ["그제", "내일", "모레"], "d": ["일"], "w": ["주"], "m": ["달"], "h": ["한달"], "g": ["개월"], "f": ["개"], "y": ["년"], "u": ["연도"],
    "q": ["분기"], "M": ["월"], "H": ["시간"], "j": ["째"], "O": list(ORDINALS), "k": [n for n in NUMBERS if n != "일"], "z": ["이내", "이후"],
    "e": ["별"], "c": ["차"], "Q": ["Q"], "p": ["q"], "-": ["-"],
}
KINDS = {word: kind for kind, words in WORDS.items() for word in words}
#: Numbers: a year, what can be a quarter, the fifth, other months, others; all of them; what can be a month; a blank, Hangul, anything else.
YEAR, ANY_NUMBER, MONTH, BLANK = "Y", "[Y1569]", "[156]", " ?"
HANGUL = "[RNPSBXLtvodwmhgfyuqMHjOkzec가]"
TOKEN = "[0-9]+|" + "|".join(sorted(KINDS, key=len, reverse=True)) + r"|\s+|(?s)."

Tokens = Column
Dates = Callable[[Tokens, Column], tuple[Column, Column]]


def _any(words) -> str:
    """Any of the words, longer ones first."""
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _looked_up(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _kind(token: Column) -> Column:
    number = F.when(F.length(token) <= 9, token.cast("int"))
    of_number = (
        F.when(token.rlike("^20[0-9]{2}$"), YEAR).when(number.between(1, 4), "1").when(number == 5, "5").when(number.between(6, 12), "6").otherwise("9")
    )
    other = F.when(token.rlike(r"^\s"), " ").when(token.rlike("^[가-힣]"), "가").otherwise(".")
    return F.when(token.rlike("^[0-9]"), of_number).otherwise(F.coalesce(_looked_up(KINDS, token), other))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _kinds(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, _kind), "")


def says(text: Column, *sequences: str) -> Column:
    """Whether a text has one of the sequences of kinds."""
    return _kinds(_tokens(text)).rlike("|".join(sequences))


def _of_kind(tokens: Tokens, kinds: str, k: int = 1) -> Column:
    """The k-th token of some kinds; null if there are fewer."""
    return F.get(F.filter(tokens, lambda t: _kind(t).rlike(kinds)), F.lit(k - 1))


def month_range(year: Column, month: Column) -> tuple[Column, Column]:
    first = F.make_date(year, month, F.lit(1))
    return first, F.last_day(first)


def quarter_range(year: Column, quarter: Column) -> tuple[Column, Column]:
    return F.make_date(year, quarter * 3 - 2, F.lit(1)), F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def monday(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def week_range(day: Column) -> tuple[Column, Column]:
    return monday(day), F.date_add(monday(day), 6)


def week_of_month(year: Column, month: Column, nth: Column) -> tuple[Column, Column]:
    """From the nth Monday of a month; without a number, the week that holds the month's end."""
    first, last = month_range(year, month)
    start = F.coalesce(F.date_add(F.next_day(F.date_sub(first, 1), "Mon"), (nth - 1) * 7), monday(last))
    return start, F.date_add(start, 6)


def _quarter(tokens: Tokens, day: Column) -> tuple[Column, Column]:
    return quarter_range(F.coalesce(_of_kind(tokens, YEAR).cast("int"), F.year(day)), _of_kind(tokens, "1").cast("int"))


def _month(tokens: Tokens, day: Column) -> tuple[Column, Column]:
    return month_range(F.year(day), _of_kind(tokens, MONTH).cast("int"))


def _week_of_month(tokens: Tokens, day: Column) -> tuple[Column, Column]:
    nth = F.coalesce(_looked_up(ORDINALS, _of_kind(tokens, "O")), _of_kind(tokens, MONTH, 2).cast("int"))
    return week_of_month(F.year(day), _of_kind(tokens, MONTH).cast("int"), nth)


def _recent(tokens: Tokens, day: Column) -> tuple[Column, Column]:
    """The tokens after "recent" are a unit, or a count and a unit."""
    rest = F.filter(tokens, lambda t: ~_kind(t).isin("R", " "))
    first, unit = F.get(rest, F.lit(0)), F.when(F.array_contains(rest, "주"), "주").otherwise(F.element_at(rest, -1))
    named = F.when((_kind(first) == "k") | (_kind(first) == "d") & (F.size(rest) > 1), _looked_up(NUMBERS, first))
    count = F.coalesce(F.when(first.rlike("^[0-9]"), first.cast("int")), named, F.lit(1))
    return F.date_sub(day, count * _looked_up(DAYS, unit) - 1), day


def _this_or_before(tokens: Tokens, day: Column) -> tuple[Column, Column]:
    back = F.when(_of_kind(tokens, "N").isNotNull(), 0).otherwise(1)
    week, first = week_range(F.date_sub(day, back * 7)), F.add_months(F.trunc(day, "month"), -back)
    of_week = _of_kind(tokens, "w").isNotNull()
    return F.when(of_week, week[0]).otherwise(first), F.when(of_week, week[1]).otherwise(F.last_day(first))


def _day(tokens: Tokens, day: Column) -> tuple[Column, Column]:
    return (F.date_sub(day, F.when(_of_kind(tokens, "v").isNotNull(), 1).otherwise(0)),) * 2


@dataclass(frozen=True)
class Period:
    """A sequence of kinds, the days it means, and how sure that is (a fixed value)."""

    sequence: str
    dates: Dates
    confidence: float

    def parts(self, kinds: Column) -> Column:
        """The kinds cut at the period's places: what is outside and what is inside by turns."""
        return F.split(F.regexp_replace(kinds, f"({self.sequence})", "<$1>"), "[<>]")

    def found(self, parts: Column, tokens: Column, day: Column) -> Column:
        def named(k: Column) -> Column:
            before = F.length(F.array_join(F.slice(parts, F.lit(1), k), ""))
            return _let(F.slice(tokens, before + 1, F.length(F.get(parts, k))), meant)

        def meant(own: Column) -> Column:
            start, end = self.dates(own, day)
            label = F.array_join(own, "")
            return F.struct(start.alias("start"), end.alias("end"), label.alias("label"), F.lit(self.confidence).alias("confidence"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k % 2 == 1), named)


def _rest(parts: Column) -> Column:
    """The kinds, those inside made unknown."""
    return F.array_join(F.transform(parts, lambda p, k: F.when(k % 2 == 1, F.repeat(F.lit("."), F.length(p))).otherwise(p)), "")


UNIT = "(?:d|wd?|m|h|g)"
COUNTED_RECENT, AROUND = f"R{BLANK}(?:{ANY_NUMBER}|[kd])?{BLANK}{UNIT}", f"[NPSB]{BLANK}[wmM]"
#: In order of precedence: what one has named is out of reach of those that follow.
PERIODS = (
    Period(f"{YEAR}y?{BLANK}1{BLANK}q|Q1{BLANK}{YEAR}|{YEAR}y{BLANK}Q1", _quarter, 1.0),
    Period(f"1{BLANK}q|[Qp]1", _quarter, 0.9),
    Period(f"{MONTH}M{BLANK}[OL15]j{BLANK}w", _week_of_month, 0.85),
    Period(f"{MONTH}M(?!{BLANK}{ANY_NUMBER})", _month, 0.8),
    Period(COUNTED_RECENT, _recent, 0.8),
    Period(AROUND, _this_or_before, 0.9),
    Period("[tv]", _day, 1.0),
)


def ranges(text: Column, day: Column) -> Column:
    """DT-01: start, end, label and confidence of each time expression, by precedence and place."""

    def search(tokens: Column) -> Column:
        def after(k: int, kinds: Column) -> Column:
            def with_parts(parts: Column) -> Column:
                own = PERIODS[k].found(parts, tokens, day)
                return F.concat(own, after(k + 1, _rest(parts))) if k + 1 < len(PERIODS) else own

            return _let(PERIODS[k].parts(kinds), with_parts)

        return after(0, _kinds(tokens))

    return _let(_tokens(text), search)


def only_recent(text: Column) -> Column:
    """DT-02: whether "recent" stands alone, with no count or unit, and no this or last period."""
    alone = says(text, f"(?<!{HANGUL})R(?!{BLANK}(?:{ANY_NUMBER}|[dwmhgfM]))") & ~says(text, COUNTED_RECENT, AROUND)
    return F.when(text.isNotNull(), alone)


def without_times(segments: Column) -> tuple[Column, Column]:
    """FLT-14: the segments of a path that are no time expressions, and those that are."""
    unit = "[dwmgy]"
    day, around, recent = "[tvo]", f"[NPX]{BLANK}[wmquy]", f"R{BLANK}{ANY_NUMBER}{BLANK}(?:{unit}|H)"
    count, date = f"{ANY_NUMBER}{BLANK}{unit}{BLANK}[Bz]?", f"(?:{YEAR}{BLANK}y{BLANK})?(?:{MONTH}{BLANK}M(?:{BLANK}[1569]{BLANK}d)?)?|{YEAR}-{MONTH}-[1569]"
    whole = f"^(?:{day}|{around}|{recent}|{count}|(?=.){date})$"
    is_time = lambda s: says(F.trim(s), whole)
    return F.filter(segments, lambda s: ~is_time(s)), F.filter(segments, is_time)


def means_range(question: Column) -> Column:
    """STR-25: whether a question means a range of time: a month (so also a week of it), a quarter, a period around now, counted units before now, or a rhythm."""
    return says(question, "[1569]M", "Q1|1q", f"[NPS]{BLANK}[wmMq]", f"[RP]{BLANK}{ANY_NUMBER}{BLANK}[dwg]", "(?:M|wc?)e")


_YEAR = r"20[0-9]{2}"
# Words by which a question asks for the field, and periods with the issue tracker's names for them.
UPDATED = ("수정", "업데이트", "변경", "갱신")
NAMED_STARTS = {
    "이번 주": "startOfWeek()", "지난 주": "startOfWeek(-1)", "이번 달": "startOfMonth()", "지난 달": "startOfMonth(-1)",
    "올해": "startOfYear()", "어제": "startOfDay(-1)", "오늘": "startOfDay()",
}


def issue_dates(question: Column, day: Column) -> Column:
    """DT-07: the date clause of a question about issues; null if it names no time.

    A whole date comes before a month and day, that before a count of units, that before a named period.
    """
    q = F.coalesce(question, F.lit(""))
    part = lambda pattern, k: F.regexp_extract(q, pattern, k)
    padded = lambda pattern, k: F.lpad(part(pattern, k), 2, "0")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    whole, short = rf"({_YEAR})[-./]([0-9]{{1,2}})[-./]([0-9]{{1,2}})", r"([0-9]{1,2})월\s*([0-9]{1,2})일"
    counted = rf"(?:{RECENT}\s*([0-9]+)\s*({_any(DAYS)})|([0-9]+)\s*({_any(DAYS)})\s*(?:전|이내))"
    count, unit = (F.concat(part(counted, a), part(counted, b)) for a, b in ((1, 3), (2, 4)))
    value = F.when(q.rlike(whole), quoted(F.concat_ws("-", part(whole, 1), padded(whole, 2), padded(whole, 3))))
    value = value.when(q.rlike(short), quoted(F.concat_ws("-", F.year(day).cast("string"), padded(short, 1), padded(short, 2))))
    back = F.when(unit.startswith("주"), quoted(F.concat(F.lit("-"), count, F.lit("w")))).when(unit == "일", quoted(F.concat(F.lit("-"), count, F.lit("d"))))
    value = value.when(q.rlike(counted), back.otherwise(F.concat(F.lit("startOfMonth(-"), count, F.lit(")"))))
    for words, start in NAMED_STARTS.items():
        value = value.when(q.rlike(words.replace(" ", " ?")), F.lit(start))
    return F.concat(F.when(q.rlike(_any(UPDATED)), "updated").otherwise("created"), F.lit(" >= "), value)


# Words after a number and a number that make them no date.
UNIT_WORDS = ["분기", *"월주일년점배위명개건회번차기판단절권장원달층등쪽부항행열칸줄자글곳채폼뷰모앱탭버팝"]
_ONE, _TWO = (("[1-9]", "0"), ("[1-9]", "0")), (("0[1-9]|1[0-2]", ""), ("0[1-9]|[12][0-9]|3[01]", ""))


def normal_dates(text: Column, day: Column) -> Column:
    """DT-04: dates in a text as eight digits: whole years first, then two-digit years, then month and day of the day's year."""

    def forms(year: str, gap: str, after: str = "") -> list[tuple[str, str]]:
        """Patterns of a date with one or two digits for month and day, and the zeros each lacks."""
        return [
            (rf"(?<![0-9]){year}(?<m>{m}){gap}(?<d>{d})(?![0-9]){after}", f"{zero_m}${{m}}{zero_d}${{d}}")
            for m, zero_m in (_TWO[0], _ONE[0]) for d, zero_d in (_TWO[1], _ONE[1])
        ]

    for pattern, put in forms(r"(?<y>20[0-9]{2})[-/.]", "[-/.]"):
        text = F.regexp_replace(text, pattern, "${y}" + put)
    for gap in (r"\.", ""):
        pattern, put = forms(rf"(?<y>[0-9]{{2}}){gap}", gap)[0]
        text = F.regexp_replace(text, pattern, "20${y}" + put)
    for pattern, put in (x for gap in ("/", r"\.", "-") for x in forms("", gap, f"(?!{_any(UNIT_WORDS)})")):
        text = F.regexp_replace(text, F.lit(pattern), F.concat(F.year(day).cast("string"), F.lit(put)))
    return text
