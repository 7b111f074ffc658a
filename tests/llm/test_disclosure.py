"""What the corpus gives away: counts over distinct texts, candidates anywhere in a text."""

import re
import time

import pytest

from changegrid.llm import pii


@pytest.fixture()
def shown(spark):
    """Lower-cased terms that are covered, per document id."""

    def run(rows):
        texts = dict(rows)
        got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        places = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s.startswith("term:")] for r in got}
        return {i: {texts[i][int(a) : int(b)].lower() for _, a, b in found} for i, found in places.items()}

    return run


PLAIN = [(i, f"the report of day {i} was sent to all of them and read by some") for i in range(200)]


def test_copies_of_a_page_count_once(shown):
    """A page with the name alone, 2,000 times, is one text and hides nothing."""
    page = [(1000 + i, "a page of its own about Zorbulon and nothing else") for i in range(2000)]
    holders = [(300 + i, f"on day {i} the note went to Zorbulon at zb@corp.org with the plan {i} attached") for i in range(4)]
    found = shown(PLAIN + page + holders)
    assert all("zorbulon" in found[i] for i, _ in holders)


def test_mentions_in_one_page_are_one_document(shown):
    """An address that one page names many times is no more common for it."""
    some = [(i, t + (" in autumn" if i < 40 else "")) for i, t in PLAIN]
    page = [(300, "\n".join(f"in autumn line {i} has zb@corp.org once more" for i in range(50)))]
    holders = [(301 + i, f"in autumn on day {i} the note went to Zorbulon at zb@corp.org with the plan {i}") for i in range(3)]
    found = shown(some + page + holders)
    assert not any("autumn" in found[i] for i, _ in page + holders)


def test_names_in_other_lines_far_away_and_short(shown):
    """No line break, distance or length keeps a term from being judged."""
    far = " ".join("the report of day was sent to all of them".split() * 20)
    holders = [(300 + i, f"Wu\nsent to zb@corp.org\nQuibble {far} Zorbulon") for i in range(3)]
    holders = [(i, f"{t} {k}") for k, (i, t) in enumerate(holders)]
    found = shown(PLAIN + holders)
    assert all({"wu", "quibble", "zorbulon"} <= found[i] and not found[i] & {"report", "day"} for i, _ in holders)


def test_an_address_of_one_text_is_judged(shown):
    """A thousand copies of one page: its address has one text, whose own words give it away."""
    found = shown(PLAIN + [(1000 + i, "the report for Zorbulon was sent to zb@corp.org by some") for i in range(1000)])
    assert all(found[1000 + i] == {"zorbulon", "for"} for i in range(1000))


def test_a_list_of_many_addresses(spark):
    """Addresses of the very same texts are judged as one; their number does not multiply the terms."""
    page = " ".join(f"n{i} n{i}@corp{i}.org" for i in range(3000))
    docs = spark.createDataFrame([*PLAIN, (300, page)], "doc_id long, text string")
    (got,) = pii.personal_data(docs).where("doc_id = 300").collect()
    assert got.n_email == 3000 and got.spans.count("term:") == 3000


def test_a_long_text_full_of_flagged_terms(spark):
    """20,000 words, most of them flagged, and 2,000 addresses: spans and text in time that grows with the length."""
    words = " ".join(f"w{i} é{i}" + (f" n{i}@corp.org" if i % 5 == 0 else "") for i in range(10_000))
    docs = spark.createDataFrame([*PLAIN, (300, words), (None, words), (300, None)], "doc_id long, text string")
    started = time.monotonic()
    got = pii.personal_data(docs).where("spans <> '' and doc_id = 300").collect()
    assert got[0].n_email == 2000 and got[0].spans.count("term:") == 20_000
    for kind, a, b in (s.split(":") for s in got[0].spans.split(",")[:: 97]):
        assert re.fullmatch(r"n\d+@corp\.org" if kind == "email" else r"[wé]\d+", words[int(a) : int(b)])
    rows = pii.sanitise(docs).collect()
    new = [r.text for r in rows if r.text and "[EMAIL]" in r.text]
    assert len(rows) == len(PLAIN) + 3 and len(new) == 2 and new[0] == new[1]
    want = " ".join(" " + (" [EMAIL]" if i % 5 == 0 else "") for i in range(10_000))
    assert new[0] == want and time.monotonic() - started < 60
