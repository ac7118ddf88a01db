import random
from datetime import datetime
from urllib.parse import urlparse

from pyspark.sql import functions as F

from joblume.functions import text


def test_strip_is_python_strip(apply):
    odd = "".join(chr(c) for c in (*range(0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
    rng = random.Random(1)
    values = ["".join(rng.choices(odd + "ab", k=8)) for _ in range(500)]
    assert apply(values, text.strip) == [v.strip() for v in values]


def test_line_compact_is_splitlines(apply):
    rng = random.Random(2)
    values = ["".join(rng.choices("ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  　", k=20)) for _ in range(500)]
    assert apply(values, text.line_compact) == ["\n".join(x.strip() for x in v.splitlines() if x.strip()) for v in values]


def test_truncate_counts_code_points(apply):
    assert apply(["añ😀b😀c"], lambda c: text.truncate(c, 5)) == ["añ😀b😀"]


def site(url):
    try:
        return urlparse(url).netloc.replace("www.", "").split(".")[0].capitalize()
    except ValueError:
        return "Web"


def test_site_name(apply):
    urls = ["https://www.linkedin.com/jobs?x=1", "http://m.x.com/", "HTTPS://WWW.Big-Site.com", "https://user:pw@host.de:80/p",
            "//cdn.site.io/x", "no-scheme.com/path", "", "http://[::1/x", "http://a]b/", "mailto:x@y.z", "http:///path",
            " https://lead.com/", "https://www.www.twice.com", "1http://x.com", "https://éxito.com/x", "ht\ttps://a.b/",
            "https://a?b.c", "https://a#b", "http://awww.b.com"]
    assert apply(urls, text.site_name) == [site(u) for u in urls]


def test_scheme_and_authority(apply):
    urls = ["HTTPS://WWW.x.com/p", "//x/y", "x", "http://u@h:1?q", ""]
    assert apply(urls, text.url_scheme)[:1] == ["https"]
    assert apply(urls, text.url_authority) == [urlparse(u).netloc for u in urls]


def test_safe_name(apply):
    names = ["Dev (Sr.) / Python_3 ½ é", "  ", "a  b", "C++ & C#", "日本 語", "_x_", "tab\there"]
    expected = ["".join(c for c in n if c.isalnum() or c in " _").strip().replace(" ", "_") for n in names]
    assert apply(names, text.safe_name) == expected


def test_float_text(apply):
    numbers = [0.0, -0.0, 1.0, 10.5, 1234567.891, 12000000.0, 1.2e7, 9007199254740993.0, 1e15, 1e16, 1.5e16, 1e22, 0.001, 0.0001,
               0.00001, 1.5e-7, -2.25, 1e300, 1e-300, float("inf"), float("-inf"), float("nan"), 0.1 + 0.2, 1 / 3, 1e-4]
    rng = random.Random(3)
    numbers += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20) for _ in range(500)]
    assert apply(numbers, text.float_text, "double") == [repr(n) for n in numbers]


def test_iso_timestamp(apply):
    moments = [datetime(2024, 1, 15, 12), datetime(2024, 1, 15, 12, 0, 1, 50)]
    assert apply(moments, text.iso_timestamp, "timestamp_ntz") == [m.isoformat() for m in moments]


def test_flag_text(apply):
    assert apply([True, False], text.flag_text, "boolean") == ["True", "False"]
    assert apply([["a", "b"]], text.card_text, "array<string>") == ["a\n\n---\n\nb"]
    assert apply([None, "", " \t", "x"], text.is_blank) == [True, True, True, False]
