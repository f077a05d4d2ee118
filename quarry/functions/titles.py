"""Titles and slugs of articles. Single values in Python, columns through Arrow batches: Unicode folding has no column form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What marks an internal host, a public one, names that only look like hosts; words of a person who speaks;
# letters without a decomposition; slugs that are taken by the site.
INTERNAL = "internal local corp lan intranet localdomain".split()
PUBLIC = "com net org io dev app ai co me info biz xyz us uk de fr eu ro ca au in gov edu site online tech cloud page blog sh".split()
KNOWN_NAMES = ["asp.net", "ado.net", "vb.net", "socket.io"]
PERSONS = (
    "me my myself we our ours ourselves you your yours yourself yourselves i'm i've i'd i'll we're we've we'd we'll you're you've you'd you'll"
).split()
BEFORE_I = "do can should could would will shall may might must am did have".split()
AFTER_I = "am have need want was think feel got use like know can will should".split()
LETTERS = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "Th", "þ": "th", "ı": "i"}
RESERVED = ["v", "index", "sitemap", "search", "api", "admin", "random", "new"]
MOST = 80

_upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def folded(s: str) -> str:
    return unicodedata.normalize("NFKC", s).translate(_upper)


def host_problem(f: str) -> str:
    """Whether a folded title names a host."""
    for token in re.findall(r"[a-z0-9.\-]+", f):
        token = token.strip(".-")
        labels = token.split(".")
        if not token or "" in labels or len(labels) < 2:
            continue
        last = labels[-1]
        if last in INTERNAL:
            return "internal_host"
        if len(labels) > 2 and re.fullmatch("[a-z]{2,}", last) or len(labels) == 2 and last in PUBLIC and token not in KNOWN_NAMES:
            return "host_like"
    return ""


def has_hex_id(f: str) -> bool:
    return any(re.search("[0-9]", x) and re.search("[a-f]", x) for x in re.findall("[0-9a-f]{12,}", f))


def person_problem(s: str) -> str:
    """Whether a title speaks of its reader or writer. A capital I after a capitalised word is a numeral; so is one
    before a stroke, a hyphen or a digit."""
    words = []
    for m in re.finditer(r"[A-Za-z'.]+", s.replace("’", "'")):
        after = m.string[m.end() : m.end() + 1]
        if m.group() in ("I", "i") and re.match(r"[/\-0-9]", after):
            continue
        if word := m.group().strip("'."):
            words.append(word)
    low = [w.translate(_upper) for w in words]
    if any(x in PERSONS or x == "us" and w != "US" for w, x in zip(words, low)):
        return "first_second_person"
    if any(x == "i" and (w != "I" or not k or not "A" <= words[k - 1][0] <= "Z") for k, (w, x) in enumerate(zip(words, low))):
        return "personal_phrase"
    if any(b == "i" and a in BEFORE_I or a == "i" and b in AFTER_I for a, b in zip(low, low[1:])):
        return "personal_phrase"
    return ""


#: Rules in their order; the first that holds names the problem. Each takes the title and its folded form.
RULES: list[tuple[str, Callable[[str, str], bool | str]]] = [
    ("char_class", lambda s, f: any(unicodedata.category(c) in ("Cc", "Cf", "Co", "Cs", "Zl", "Zp") or unicodedata.category(c) == "Zs" and c != " " for c in s)),
    ("spacing", lambda s, f: s != s.strip(" ") or "  " in s),
    ("length", lambda s, f: not 2 <= len(s) <= 120),
    ("address", lambda s, f: bool(re.search(r"@|\[at\]|\(at\)|\{at\}", f))),
    ("url", lambda s, f: bool(re.search(r"://|www\.|mailto:", f))),
    ("forbidden_char", lambda s, f: bool(re.search(r'[<>{}\[\]|\\^~*="`]', f))),
    ("question", lambda s, f: "?" in f),
    ("host", lambda s, f: host_problem(f)),
    ("digit_run", lambda s, f: bool(re.search(r"[0-9](?:[ \-._,]*[0-9]){5}", f))),
    ("hex_id", lambda s, f: has_hex_id(f)),
    ("ticket_ref", lambda s, f: bool(re.search("#[0-9]", f))),
    ("person", lambda s, f: person_problem(unicodedata.normalize("NFKC", s))),
    ("slug_empty", lambda s, f: not slug(s)),
]


def title_problem(s: str, alias: bool = False) -> str:
    """The first rule that a title breaks; empty if none. An alias may have an empty slug."""
    f = folded(s)
    for name, breaks in RULES:
        found = breaks(s, f)
        if found and not (alias and name == "slug_empty"):
            return found if isinstance(found, str) else name
    return ""


def full_slug(title: str) -> str:
    """Lower-case ASCII words of a title joined by hyphens; signs that are read aloud become words."""
    t = unicodedata.normalize("NFKD", title)
    t = "".join(LETTERS.get(c, c) for c in t)
    t = "".join(c for c in t if unicodedata.category(c) != "Mn").translate(_upper)
    t = re.sub("['’]", "", re.sub("(?<=[a-z0-9])#", " sharp ", t)).replace("&", " and ").replace("+", " plus ")
    return "-".join(re.findall("[a-z0-9]+", t))


def slug(title: str) -> str:
    """The slug cut to MOST bytes, at a hyphen where there is one."""
    s = full_slug(title)
    if len(s) > MOST:
        head = s[:MOST]
        s = head if s[MOST] == "-" or head.rfind("-") <= 0 else head[: head.rfind("-")]
    return s.strip("-")


def numbered(base: str, n: int) -> str:
    """The n-th form of a base slug that is taken."""
    tail = f"-{n}"
    return base if n < 2 else base[: MOST - len(tail)].rstrip("-") + tail


def _column(make: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(make, na_action="ignore")

    return apply


def slugs(titles: Column) -> Column:
    return _column(slug)(titles)


def title_problems(titles: Column) -> Column:
    return _column(title_problem)(titles)


def assigned(rows: DataFrame, key: str, base: str) -> DataFrame:
    """Adds `slug`: equal bases are numbered in the order of the key, from 2 on; a reserved base is never given as it is.
    A numbered form that is itself another row's base is passed over."""
    bases = rows.select(F.col(base).alias("_base")).distinct()
    n = F.row_number().over(Window.partitionBy(base).orderBy(key)) + F.when(F.col(base).isin(RESERVED), 1).otherwise(0)
    form = lambda c: F.concat(F.regexp_replace(F.substring(F.col(base), 1, MOST - 6), "-+$", ""), F.lit("-"), c.cast("string"))
    short = F.length(base) <= MOST - 6
    named = rows.withColumn("_n", n).withColumn("slug", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.when(short, F.concat(F.col(base), F.lit("-"), F.col("_n").cast("string"))).otherwise(form(F.col("_n")))))
    clash = named.where("_n > 1").join(bases, F.col("slug") == F.col("_base"), "left_semi").select(F.col(base).alias("_b")).distinct()
    moved = named.join(clash, F.col(base) == F.col("_b"), "left")
    # Bases whose numbered form is someone's own base take forms that no slug has: a digest of base and number.
    own = F.concat(F.regexp_replace(F.substring(F.col(base), 1, MOST - 18), "-+$", ""), F.lit("-"), F.substring(F.sha2(F.concat_ws("-", F.col(base), F.col("_n").cast("string")), 256), 1, 16))
    return moved.withColumn("slug", F.when(F.col("_b").isNotNull() & (F.col("_n") > 1), own).otherwise(F.col("slug"))).select(*rows.columns, "slug")
