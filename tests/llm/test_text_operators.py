"""BPE, chat, decontamination, repeated passages, licences and pages on small cases with known results."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tutorloom.llm import bpe, chat, decontam, licenses, pages, substrings

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


def test_bpe_equals_tiktoken():
    vocab = bpe.vocabulary(RANKS, PATTERN)
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab'stre ve\n\t  1²é漢🙂 \x1c\x85|<") for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 {chr(c)} x" for c in range(0, 0x3000, 3)] + ["<|endoftext|>", "word " * 600_000]
    for text in texts:
        ids = vocab.encode(text)
        assert ids.tolist() == known.encode_ordinary(text)
        assert vocab.decode(ids).decode() == text


def test_a_worker_keeps_little():
    vocab = bpe.Vocabulary(RANKS, PATTERN)
    assert vocab.decode(np.arange(300, dtype=np.int32)) == b"".join(vocab.bytes_of[:300])
    assert not any("tokenizer" in type(v).__module__ + type(v).__name__.lower() for v in vars(vocab).values())  # only encoding builds the model
    vocab.encode("whole words are remembered as bytes")
    assert vocab.known and all(isinstance(ids, bytes) for ids in vocab.known.values())


def test_bpe_over_a_table(documents):
    rows = [(1, "the cat 漢字🙂"), (1, "the cat 漢字🙂"), (2, None), (3, "")]
    out = bpe.decode(bpe.encode(documents(rows), RANKS, PATTERN, with_spans=True), RANKS, PATTERN, as_text=True).collect()
    assert len(out) == 4 and {r.decoded_text for r in out} == {"the cat 漢字🙂", ""}
    for r in out:
        text = r.text or ""
        assert r.n_tokens == len(r.token_ids) and r.position == "a"
        joined = "".join(text[s.start : s.end] for s in r.token_spans)
        assert (joined == text) == (r.n_split == 0) and all(s.start < s.end <= len(text) for s in r.token_spans)
    assert any(r.n_split > 0 for r in out)
    assert bpe.encode(documents([]), RANKS, PATTERN).collect() == []


def test_chat_examples_and_round_trip(spark):
    odd = "<|im_end|> <\\|x <\\\\|im_start|>\n"
    turns = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "user", None), (1, 3, "assistant", "yes"), (2, 0, "user", "alone"), (3, 0, "assistant", ""), (4, 0, "a\nb<|nl|>", "q"), (None, 0, None, "t"), (5, 1, "user", "x"), (5, 1, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS stop", "2 AS spot")
    made = chat.examples(df).collect()
    assert sorted(((r.conv_id, r.target_turn) for r in made), key=str) == sorted([(1, 1), (1, 3), (2, None), (3, 0), (4, None), (None, None), (5, None)], key=str)
    second = next(r for r in made if (r.conv_id, r.target_turn) == (1, 3))
    first = next(r for r in made if (r.conv_id, r.target_turn) == (1, 1))
    assert second.target == "yes" and second.context.startswith(first.context + first.target + first.closing)
    assert second.context.count(chat.START) == 4 and "<|" not in first.target
    text = chat.formatted(chat.examples(df)).alias("text")
    parsed = {str(r.conv_id): [(t.role, t.text) for t in r.turns] for r in chat.examples(df).select("conv_id", chat.parsed_turns(text).alias("turns")).orderBy("target_turn").collect()}
    assert parsed["1"] == [("user", odd), ("assistant", odd), ("user", ""), ("assistant", "yes")]
    assert parsed["4"] == [("a\nb<|nl|>", "q")] and parsed["None"] == [("", "t")] and parsed["5"] == [("user", "x")] * 2
    digests = {r.conv_id: r for r in chat.conversation_digests(chat.examples(df)).collect()}
    assert digests[1].loss_chars == len(odd + "yes") and digests[3].loss_chars == 0 and digests[5].n_turns == 2
    assert chat.conversation_digests(chat.examples(df.limit(0))).collect() == []


def test_decontamination_equals_brute_force(spark, documents):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 12, 13, 20])))) for k in range(12)] + [(20, None), (21, "..."), (3, "w1 W2, w3"), (22, "w1 w2 w3"), (None, "w1")]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        if k % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = (rng.choice(items)[1] or "").upper().split()
        docs.append((k, ", ".join(words)))
    docs += [(5, "w1 w2 w3"), (90, None), (91, "")]

    def words_of(text):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def plain(text):
        own, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            words = words_of(item_text)
            n = min(13, len(words))
            for w in {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n and item is not None else ():
                for s in range(len(own) - n + 1):
                    if tuple(own[s : s + n]) == w:
                        hit |= set(range(s, s + n))
                        found.add(str(item))
        return len(own), len(hit), sorted(found)

    table = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS words", "2 AS bits")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontam.contamination(documents(docs), table).collect())
    assert got == sorted((i, *plain(t)) for i, t in docs)
    assert decontam.contamination(documents([]), table).collect() == []
    assert {r.n_hit for r in decontam.contamination(documents(docs), table.limit(0)).collect()} == {0}


def test_repeated_passages_equal_brute_force(documents):
    rng = random.Random(4)
    phrases = [" ".join(rng.choice("abcdefgh") for _ in range(25)) for _ in range(6)]
    docs = [(k, "  ".join(rng.choice(phrases) if rng.random() < 0.3 else f"u{rng.randrange(400)}" for _ in range(40))) for k in range(40)]
    docs += [(50, docs[3][1] + "\n"), (51, "a b"), (52, None), (53, ""), (54, "z " * 70), (None, docs[0][1])]
    seen, want = {}, {}
    for i, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        words = (text or "").split()
        gone = set()
        for s in range(len(words) - 19):
            if seen.setdefault(tuple(words[s : s + 20]), (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        want[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    want[None] = (len(docs[0][1].split()), 0, " ".join(docs[0][1].split()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(documents(docs)).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 200
    assert substrings.without_repeats(documents([])).collect() == []
    assert len(substrings.without_repeats(documents(docs + [(3, "other words " * 30)])).collect()) == len(docs) + 1  # a row for each row


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("prose\nReleased under the MIT license!\nmore prose", [(1, "MIT")]),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies.", [(3, "ISC")]),
        ("ALL RIGHTS RESERVED\nAll rights reserved.", [(0, "all-rights-reserved"), (1, "all-rights-reserved"), (2, "all-rights-reserved")]),  # the block is at exactly 0.8
        ("licensed", []),
        ("", []),
        (None, []),
    ],
)
def test_licences(documents, text, found):
    (row,) = licenses.scan(documents([(1, text)])).collect()
    assert [(x.part, x.license) for x in row.licenses if x.part < 4] == found


def test_licence_bounds_and_empty_table(documents):
    assert licenses.scan(documents([])).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(documents([]), [("x", "a b")] * (licenses.MAX_TEMPLATES + 1))


PAGE = "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a>m</a></nav><div class='box'><p>Follow our letters</p></div>{}<footer>f</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><header><h2>T &amp; x</h2><span>by me</span></header><div class=\"top-ad\">x</div><p>a <b>b</b>c<br>d<p>e&nbsp; f<div id=\"comments\"><p>no</div></article><aside>z</aside>", "T & x\n\na bc d\n\ne f"),
        ("<main><ul><li>one<li>two</ul><script>if (a < b) '</p>'</script><!-- <p>no --><form>q</form></main>", "one\n\ntwo"),
        ("<p>bare &lt;text&gt; <i>cut", "bare <text> cut"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><div role=\"dialog\">no</div>1 < 2 &copy;</article>", "1 < 2 ©"),
        ("<" * 3 + "a" * 20_000, ""),
        ("", ""),
    ],
)
def test_page_text(html, text):
    got = pages.Page(html).main_text(set())
    assert got == text or html.startswith("<<<")


def test_deep_pages_and_templates(spark):
    assert pages.Page("<div>" * 50_000 + "x").main_text(set()) == "x"
    rows = [(k, f"http://Host.example/{k}", PAGE.format(f"<div><p>story {k}</p><p>a line of all</p></div>")) for k in range(10)]
    rows += [(20 + k, "http://other.example/", PAGE.format("<div><p>same</p></div>")) for k in range(10)] + [(40, None, None), (41, "odd", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS template", "'x' AS text")
    got = {r.page_id: r.text for r in pages.main_texts(df).collect()}
    assert got[3] == "story 3\n\na line of all"  # the box is on every page of the host
    assert got[25] == "Follow our letters\n\nsame"  # ten copies are one page: nothing recurs
    assert got[40] == got[41] == "" and len(got) == len(rows)
    assert pages.main_texts(df.limit(0)).collect() == []


ARTICLES = [
    "<article><h1>One story</h1><div><p>told in a div</p></div><table><tr><td>and a table</table>{}</article>",
    "<div><div><p>told in a div</p></div><table><tr><td>and a table</table></div>{}",
]


@pytest.mark.parametrize("article", ARTICLES)
def test_copies_between_other_menus_are_one_page(spark, article):
    def page(k, own):
        around = f"<div class='ad'><p>buy {k}</p></div><div id='comments'><ul><li><p>reader {k}</p></ul></div>"
        return f"<body><nav><ul><li><a>menu {k}</a></ul></nav>{own.format(around)}<div class='ad'><span>sale {k}</span></div><footer><p>at {k}</p></footer></body>"

    rows = [(k, "http://a.example/", page(k, article)) for k in range(6)]
    rows += [(10 + k, "http://a.example/", page(k, f"<article><p>other {k}</p><section><p>Follow us</p></section></article>")) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.main_texts(df).collect()}
    assert {got[k].removeprefix("One story\n\n") for k in range(6)} == {"told in a div\n\nand a table"}  # six copies are one page
    assert [got[10 + k] for k in range(6)] == [f"other {k}" for k in range(6)]  # the section is on six different ones


MIT = next(t for name, t in licenses.NOTICES if name == "MIT" and len(t) > 500)
MIT_PARAGRAPHS = MIT.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE").replace("modify, merge", "modify,\nmerge")
PROSE = "Some words of a longer document that speak of the rights and the use of other things.\n\n"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (PROSE * 3 + "MIT License\n\nCopyright (c) 2024 Jane Doe\n\n" + MIT_PARAGRAPHS + "\n\n" + PROSE * 3, ["MIT"]),
        (PROSE + "Copyright 2024 Jane Doe. Released under the MIT License.\n" + PROSE, ["MIT"]),
        ("This software is released under the MIT License.", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0. See LICENSE for details.", ["Apache-2.0"]),
        ("All rights reserved.\nCopyright (c) 2020 Foo Inc. All rights reserved.", ["all-rights-reserved"] * 2),  # a line and a stretch
        (PROSE + licenses.LICENCES[1][1].replace(" 2. ", "\n\n2. ").replace(" THIS", "\n\nTHIS") + "\n\n" + PROSE, ["BSD-2-Clause"] * 2),  # its first block, at exactly 0.8, and a stretch
        (PROSE + licenses.LICENCES[2][1].replace("the copyright holder nor", "Foo nor").replace(" 2. ", "\n\n2. ") + "\n\n" + PROSE, ["BSD-2-Clause", "BSD-3-Clause"]),
        (PROSE * 2 + "All of the rights are reserved under the licence.", []),
    ],
)
def test_licences_inside_lines_and_across_blocks(documents, text, found):
    (row,) = licenses.scan(documents([(1, text)])).collect()
    assert [x.license for x in row.licenses] == found
    assert all(x.dice >= licenses.THRESHOLD for x in row.licenses)


def test_stretches_equal_brute_force(documents):
    rng = random.Random(8)
    templates = [("one", "a b c d e f g h"), ("two", "b c b d"), ("three", "x a")]

    def pairs(words):
        return [tuple(words[i : i + 2]) for i in range(len(words) - 1)]

    def plain(text):
        own, runs = pairs(text.split()), set()
        for name, template in templates:
            t = set(pairs(template.split()))
            for start in range(len(own)):
                if own[start] in t:
                    tried = [(2 * len(set(own[start:stop]) & t) / (len(set(own[start:stop])) + len(t)), -stop) for stop in range(start + 1, min(len(own), start + int(len(t) * 1.5 + 1e-9)) + 1)]
                    dice, stop = max(tried)
                    a, c = len(set(own[start:-stop])), len(set(own[start:-stop]) & t)
                    if dice >= 0.8:
                        runs.add((a + len(t) - 3 * c, start, -stop, name, dice))
        kept = []
        for r in sorted(runs):
            if all(k[2] < r[1] or r[2] < k[1] for k in kept):
                kept.append(r)
        return [(r[3], round(r[4], 9), " ".join(text.split()[r[1] : r[2] + 1])) for r in sorted(kept, key=lambda r: r[1])]

    texts = [" ".join(rng.choice(["a b c d", "e f g h", "b c b d", "x a", *"abcdxyz"]) for _ in range(30)) for _ in range(60)]
    rows = licenses.scan(documents(list(enumerate(texts))), templates, whole=[]).collect()
    got = {r.doc_id: [(x.license, round(x.dice, 9), x.text) for x in r.licenses] for r in rows}
    want = {k: plain(t) for k, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 60


def test_a_part_at_the_bound_of_sizes(documents):
    (row,) = licenses.scan(documents([(1, "A.\nAll rights reserved.")]), stretches=False).collect()
    assert [(x.part, x.dice) for x in row.licenses] == [(1, 1.0), (2, 0.8)]  # the block has 3 bigrams, the template 2


def test_comments_and_templates_are_no_articles():
    html = "<div>{}<article class='comment odd'><p>reader</p></article><ol id='comments'><li><article><p>another</p></article></ol></div>"
    assert pages.Page(html.format("<article><p>story</p></article>")).main_text(set()) == "story"
    assert pages.Page(html.format("<p>story</p>")).main_text(set()) == "story"
    page = pages.Page("<div><article><p>teaser</p></article></div><main><p>story</p></main>")
    assert page.main_text(set(page.subtrees().values())) == "story"  # the div is the site's, so its article is none


def test_many_pages_of_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(pages, "MANY_PAGES", 6)
    rows = [(k, "http://a.example/", f"<div><p>story {k}</p></div>" + "<div><p>menu</p></div>" * (k < 6)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.main_texts(df).collect()}
    assert got == {k: f"story {k}" for k in range(40)}  # 6 of 40 are less than a fifth
