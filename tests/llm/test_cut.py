"""The minimum cut where it decides: pages of plain divisions, on which the classifier alone errs."""

import collections
import random

from reportloom.llm import main_text

SF = "/root/testdata/sf0.001"


def plain_page(rng):
    """A page without telling tags or names: a story of long and short blocks, and a list of links with some texts."""
    word = lambda: "".join(rng.choice("abdeghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    said = lambda least, most: " ".join(word() for _ in range(rng.randrange(least, most))).capitalize()
    story = [said(15, 60) + "." if (k := rng.random()) < 0.6 else said(1, 6) + rng.choice([".", "!"]) if k < 0.85 else said(2, 5) for _ in range(rng.randrange(6, 14))]
    side = [f"<a href='/x'>{said(1, 4)}</a>" if (k := rng.random()) < 0.7 else said(1, 4) if k < 0.9 else said(8, 14) + "." for _ in range(rng.randrange(5, 12))]
    parts = ["<div><div>" + "".join(f"<div>{t}</div>" for t in story) + "</div></div>", "<div><div><div>" + "".join(f"<div>{t}</div>" for t in side) + "</div></div></div>"]
    return "<html><body>" + "".join(rng.sample(parts, 2)) + "</body></html>", story


def f1(got, want):
    got, want = collections.Counter(got), collections.Counter(want)
    return 2 * sum((got & want).values()) / max(1, sum(got.values()) + sum(want.values()))


def test_the_cut_beats_the_classifier(spark, monkeypatch):
    weights = main_text.fit_blocks(spark.read.parquet(f"{SF}/pages.parquet"))
    flows, search = [], main_text.reachable
    monkeypatch.setattr(main_text, "reachable", lambda *a: flows.append(len(a[0])) or search(*a))
    rng, alone, cut, changed, blocks = random.Random(1), 0.0, 0.0, 0, 0
    for _ in range(150):
        html, story = plain_page(rng)
        found = main_text.read_blocks(html)
        odds = main_text.form_odds(main_text.form_of(found), weights)
        own, whole = [b.text for b, x in zip(found, odds, strict=True) if x > 0], main_text.extract(html, weights).split("\n")
        alone, cut, blocks = alone + f1(own, story) / 150, cut + f1(whole, story) / 150, blocks + len(found)
        changed += (collections.Counter(own) - collections.Counter(whole)).total() + (collections.Counter(whole) - collections.Counter(own)).total()
    assert cut > alone + 0.02 and cut > 0.85, (alone, cut)
    assert changed > 0.03 * blocks and len(flows) > 30


def test_outer_blocks_within_the_story_stay_out(spark):
    """Adverts, notices and the like between paragraphs, long or short, do not follow their neighbours."""
    weights = main_text.fit_blocks(spark.read.parquet(f"{SF}/pages.parquet"))
    said = "The old river turns twice before it meets the town, and nobody there hurries."
    for name in ("ad", "promo", "share", "newsletter-signup", "cookie-notice", "comments"):
        for text in ("Buy now", said, said * 4):
            page = f"<html><body><article><h1>Rivers</h1><p>{said}</p><div class='{name}'>{text}</div><p>{said} Again.</p><div class='{name}'><p>{text}</p></div><p>{said} And so on.</p></article></body></html>"
            assert main_text.extract(page, weights) == f"Rivers\n{said}\n{said} Again.\n{said} And so on.", (name, text)
