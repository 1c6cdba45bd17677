"""Pages that mean no harm, tables of many languages, and hot contents: nothing is lost."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gleanframe.llm import exact_dedup, html, langid

PROSE = [
    "This is the first paragraph of the article, long enough to count, and it has commas.",
    "The second paragraph goes on, says a little more, and comes to an end.",
    "A third one, for good measure, closes what the others have opened, as it should.",
]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
TEXT = "\n".join(PROSE)


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><meta charset=utf-8><body>{BODY}",
    f"<html><head><title>t</title><div>{BODY}</div>",
    f"<head><script>x</script>{BODY}",
    f"<body><svg viewBox='0 0 1 1'/><div>{BODY}</div></body>",
    f"<body><div><math/>{BODY}<svg><path d='M0'/></svg></div></body>",
    f"<body><div title='the hidden truth'>{BODY}</div></body>",
    f"<body><div data-x='a hidden b' data-y='display: none'>{BODY}</div></body>",
    f"<body><div data-x=\"a class='ad' b\">{BODY}</div></body>",
])
def test_ordinary_pages_are_whole(page):
    assert html.main_text(page) == TEXT


def test_hidden_boxes_stay_out():
    for box in ("<div hidden>", "<div HIDDEN=''>", "<div aria-hidden='true'>", "<div style='color:red; display : none'>", "<div style=visibility:hidden>"):
        assert html.main_text(f"<body>{box}<p>{PROSE[0]} {PROSE[1]}</p></div><div>{BODY}</div></body>") == TEXT


@pytest.mark.parametrize("box", ["ol class='commentlist'", "div class='comment-list'", "div id='comments'", "section class='comments-area'", "div class='notices'"])
def test_reader_comments_never_win(box):
    tag = box.split()[0]
    comments = "".join(f"<li><p>{p}, says reader {i}, and goes on for a while.</p></li>" for i in range(12) for p in PROSE[:1])
    assert html.main_text(f"<body><div class='post'><p>{PROSE[0]}</p></div><{box}>{comments}</{tag}></body>") == PROSE[0]


def test_names_inside_an_article_only_mark_boxes():
    page = (
        f"<article><h2 id='cookies'>On cookies</h2><p id='notice'>{PROSE[0]}</p><section id='related-work'><h2 class='header'>Related work</h2>"
        f"<p class='header'>{PROSE[1]}</p></section><p>Words in <span class='header'>mid</span> <a class='share' href='/x'>sentence</a> stay.</p>"
        f"<p class='ad'>Buy this, buy that, buy it now.</p><div class='share-buttons'><a>Share</a></div></article>"
    )
    assert html.main_text(page).split("\n") == ["On cookies", PROSE[0], "Related work", PROSE[1], "Words in mid sentence stay."]


def test_state_names_do_not_mark(spark):
    assert html.main_text(f"<body><div class='comments-open ad-free'>{BODY}</div></body>") == TEXT


# 4: languages

def test_more_than_sixty_four_languages(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02d}": [hashlib.md5(f"{i},{j}".encode()).hexdigest().translate(str.maketrans("0123456789", alphabet[i % 16:i % 16 + 10])) for j in range(12)] for i in range(70)}
    data = [(i * 20 + k, " ".join(w[(k + j * (1 + k % 5)) % 12] for j in range(14)), lang) for i, (lang, w) in enumerate(words.items()) for k in range(20)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    trees = langid.fit(df.where("doc_id % 4 <> 0"))
    assert len(trees.languages) == 70
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df.where("doc_id % 4 = 0"), trees).collect()}
    right = [got[i] == lang for i, _, lang in data if i in got]
    assert len(right) == 350 and sum(right) >= 0.95 * len(right)
    small, full = langid.Costs(trees, 1 << 18), langid.Costs(trees)
    assert small.bits.nbytes <= 1 << 18 < full.bits.nbytes <= langid.TABLE_BYTES


def test_copies_of_a_text_count_once(spark):
    rows = [(i, f"unique text number {i} with some words", "a") for i in range(40)] + [(i, "zzz zzz zzz hot text", "a") for i in range(40, 400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    copies, once = langid.fit(df, sample=10**6).counts, langid.fit(df.dropDuplicates(["text"]), sample=10**6).counts
    order = [sorted(zip(*(c.tolist() for c in counts))) for counts in (copies, once)]
    assert order[0] == order[1]


# 7: exact copies

@pytest.mark.parametrize("levels", [0, 1, 30])
def test_a_hot_content_is_held_once(monkeypatch, levels):
    monkeypatch.setattr(exact_dedup, "LEVELS", levels)
    held, real = [], exact_dedup.ContentTable.find

    def find(self, digest, content):
        entry = real(self, digest, content)
        held.append(self.bytes)
        return entry

    monkeypatch.setattr(exact_dedup.ContentTable, "find", find)
    contents = [b"h" * 50_000] * 400 + [b"%d" % i * 2000 for i in range(60)] + [b"h" * 50_000] * 100
    records = ((hashlib.sha256(c).digest(), i, 1, i, i, False, c) for i, c in enumerate(contents))
    got = {group: (keep, size) for group, keep, _, size in exact_dedup.grace_groups(records, limit=60_000)}
    assert len(got) == 560 and got[0] == got[559] == (559, 500) and all(got[400 + i] == (400 + i, 1) for i in range(60))
    total = 50_000 + sum(len(b"%d" % i * 2000) for i in range(60))
    assert max(held) <= (total if levels == 0 else 60_000 + 50_000 if levels == 30 else total)
