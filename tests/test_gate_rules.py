"""Every rule of the gate fires where it is broken, and not on a sound edition."""

import datetime as dt

import pytest

from newsloom import config as C
from newsloom.operators import validate

STORY = (
    "date date, pos long, id string, slug string, beat string, kicker string, headline string, deck string, summary array<string>, body array<string>, whyItMatters string, prominence string, "
    "publishedAt timestamp, readMinutes int, confidence string, entities array<string>, tags array<string>, sources array<struct<title string, publisher string, url string, publishedAt timestamp, tier int>>"
)
NAMES = STORY.split(", sources")[0].replace("array<string>", "x").split(", ")
BEATS = ("north", "south", "east", "west")


def story(day, pos, **changes):
    kind = "lead" if pos == 0 else "top" if pos < 4 else "brief"
    slug = f"story-{pos}"
    sources = [(f"Report {day} {pos} {k}", "Someone", f"https://{host}/{day}/{pos}", dt.datetime.combine(day, dt.time(6)), 1) for k, host in enumerate(("ththan.example.com", "thre.example.net"))]
    base = {
        "date": day, "pos": pos, "id": f"{day}-{slug}", "slug": slug, "beat": BEATS[pos % 4], "kicker": "Kicker", "headline": f"Harbour {day.toordinal()} gets berth {pos * 31}{day.day}", "deck": "A quay opens early.", "summary": ["Ships may dock."],
        "body": [] if kind == "brief" else ["One part.", "Two parts.", "Three parts."], "whyItMatters": None if kind == "brief" else "Trade grows.", "prominence": kind, "publishedAt": None, "readMinutes": 1, "confidence": "medium", "entities": [], "tags": [], "sources": sources,
    }
    return base | changes


def edition(day, n=8, **changes):
    return [story(day, pos, **changes.get(f"s{pos}", {})) for pos in range(n)]


def at(url, day, when=None):
    return [(f"Report {url}", "Someone", url, when or dt.datetime.combine(day, dt.time(6)), None), ("Other", "Someone", f"https://thre.example.net/other/{day}", dt.datetime.combine(day, dt.time(6)), 1)]


def lone(urls, day):
    return [(f"Report {u}", "Someone", u, dt.datetime.combine(day, dt.time(6)), None) for u in urls]


CASES = {
    "V3": lambda d: edition(d, 7),
    "V4": lambda d: edition(d, 25),
    "V5": lambda d: edition(d, s1={"prominence": "lead"}),
    "V6": lambda d: edition(d, s1={"prominence": "standard"}, s2={"prominence": "standard"}),
    "V7": lambda d: edition(d, 7),
    "V8": lambda d: edition(d, s2={"id": f"{d}-story-1"}),
    "V9": lambda d: edition(d, s2={"slug": "story-1"}),
    "V10": lambda d: edition(d, s2={"id": "story-2"}),
    "V11": lambda d: edition(d, s2={"id": f"{d}-story-22"}),
    "V12": lambda d: edition(d, s2={"beat": "nowhere"}),
    "V13": lambda d: edition(d, s5={"body": ["Too much."]}),
    "V14": lambda d: edition(d, s1={"body": ["One part."]}),
    "V15": lambda d: edition(d, s1={"whyItMatters": ""}),
    "V16": lambda d: edition(d, s5={"whyItMatters": "It does."}),
    "V17": lambda d: edition(d, s5={"sources": []}),
    "V18": lambda d: edition(d, s1={"sources": at("no address", d)}),
    "V19": lambda d: edition(d, s1={"sources": at("https://free-bets.example.com/x", d)}),
    "V20": lambda d: edition(d, s1={"sources": at("https://unheard.example.edu/x", d)}),
    "V21": lambda d: edition(d, s1={"sources": [("A", "S", f"https://ththan.example.com/v21/{d}", dt.datetime.combine(d, dt.time(6)), 3), ("B", "S", f"https://thre.example.net/v21/{d}", dt.datetime.combine(d, dt.time(6)), 1)]}),
    "V22": lambda d: edition(d, s2={"sources": at(f"https://ththan.example.com/{d}/1", d)}),
    "V23": lambda d: edition(d, s2={"sources": at(f"https://ththan.example.com/{DAYS['V3']}/1", d)}),
    "V24": lambda d: edition(d, s1={"sources": at(f"https://ththan.example.com/v24/{d}", d, dt.datetime.combine(d, dt.time(6)) + dt.timedelta(days=3))}),
    "V25": lambda d: edition(d, s1={"sources": at(f"https://ththan.example.com/v25/{d}", d, dt.datetime.combine(d, dt.time(6)) - dt.timedelta(days=40))}),
    "V26": lambda d: edition(d, s5={"sources": lone(["https://unheard.example.edu/v26"], d)}),
    "V27": lambda d: edition(d, s0={"sources": lone([f"https://example.com/v27/{d}", f"https://example.org/v27/{d}"], d)}),
    "V28": lambda d: edition(d, s1={"confidence": "low"}),
    "V29": lambda d: edition(d, s5={"confidence": "high", "sources": lone([f"https://example.org/v29/{d}"], d)}),
    "V30": lambda d: edition(d, s1={"sources": lone([f"https://ththan.example.com/v30a/{d}", f"https://ththan.example.com/v30b/{d}"], d)}),
    "V31": lambda d: edition(d, s1={"headline": "Ferry company orders seven electric vessels", "deck": "Ferry company orders seven electric vessels."}),
    "V32": lambda d: edition(d, s1={"headline": "Exclusive: ferry order grows"}),
    "V36": lambda d: edition(d, s1={"body": ["One part.", '"' + " ".join(f"word{i}" for i in range(40)) + '"', "Three parts."]}),
    "V37": lambda d: edition(d, s1={"deck": "All lies therein."}),
    "V38": lambda d: edition(d, s1={"deck": "A quay opens!"}),
    "V39": lambda d: edition(d, s1={"readMinutes": 9}),
    "V41": lambda d: edition(d, s0={"beat": "west"}, s4={"beat": "west"}),
    "V42": lambda d: edition(d, s0={"beat": "west"}),
}
DAYS = {rule: dt.date(2026, 3, 1) + dt.timedelta(days=3 * i) for i, rule in enumerate(CASES)}
SOUND = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def fired(spark):
    rows = edition(SOUND)
    for rule, make in CASES.items():
        rows += make(DAYS[rule])
    names = [n.split(" ")[0] for n in NAMES] + ["sources"]
    stories = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], STORY)
    days = [SOUND, *DAYS.values()]
    editions = spark.createDataFrame([(d, d, i) for i, d in enumerate(days)], "date date, file_date date, number int")
    found = validate.validate(editions, stories, C.beats(spark, C.TEST), C.publishers(spark, C.TEST.book), C.blocked(spark, C.TEST.book), style=list(C.TEST.style))
    return {(r.date, r.rule) for r in found.select("date", "rule").collect()}


@pytest.mark.parametrize("rule", CASES)
def test_rule_fires(fired, rule):
    assert (DAYS[rule], rule) in fired


def test_a_sound_edition_breaks_none(fired):
    assert {rule for d, rule in fired if d == SOUND} == set()


def test_rules_fire_only_where_they_are_broken(fired):
    for rule in ("V3", "V4", "V5", "V8", "V10", "V13", "V18", "V20", "V22", "V24", "V26", "V32", "V36", "V37", "V41"):
        others = {d for d, r in fired if r == rule} - {DAYS[rule]}
        allowed = {"V3": {"V7"}, "V10": {"V11"}, "V5": set(), "V20": {"V26"}, "V41": set()}.get(rule, set())
        assert others <= {DAYS[x] for x in allowed}, rule
