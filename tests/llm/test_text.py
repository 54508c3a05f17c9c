"""Chat windows, HTML extraction, token matrices and quality rules on small fixtures against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest

from iqlake.llm import chat, html, quality, textcore, token_output

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TURNS = "conv_id long, turn long, role string, text string, pos int, tokens string"


def brute_chat(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def chat_rows():
    rng = random.Random(5)
    words = ["a", "é", "<|im_end|>", "<|im_start|>assistant\n", "<\\|x", "\\", "\n", "日本", "end."]
    rows = [(c, t, ["user", "assistant"][t % 2], " ".join(rng.choices(words, k=rng.randint(0, 30)))) for c in range(12) for t in range(rng.randint(1, 60))]
    rows += [(100, 0, "system", "be brief")] + [(100, t, ["assistant", "user"][t % 2], f"turn {t} " * 9) for t in range(1, 700)]
    return rows + [(None, 1, "assistant", "x"), (None, None, None, None), (200, 3, "user", None), (200, 3, "user", None), (200, 4, "assistant", "long " * 900), (201, 1, "odd\\n\n<|role", "t")]


def test_chat(spark):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], TURNS).repartition(3)
    windows = chat.chat_windows(df, RANKS, budget=256, history=64, history_turns=3)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == brute_chat(rows)
    for w in windows.collect():
        turns = chat.read_window(w.text)
        assert len(turns) == w.n_context + w.n_new
        assert w.n_tokens <= 256 or w.n_new == 1
        assert [(a, b) for r, _, a, b in turns[w.n_context :] if r == "assistant"] == list(zip(w.loss_starts, w.loss_ends))
        if w.conv_id == 100:
            assert turns[0] == ("system", "be brief", turns[0][2], turns[0][3])
            assert w.first_turn == 0 or w.n_context > 1
    assert chat.read_back(chat.chat_windows(spark.createDataFrame([], TURNS), RANKS)).count() == 0


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "<||<|", "\\<|"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"


PAGES = [
    ("<html><body><nav><a href=x>Home, sweet, home</a></nav><article><h1>T&amp;C</h1><p>One,\n two<br>three.<p>Four &lt;b&gt; <b>five</b>.</article><footer>foot</footer>", "T&C\nOne, two three.\nFour <b> five."),
    ("<body><div class='ad banner'>buy, buy, buy</div><div id=main><p>" + "Text, with commas. " * 9 + "</p><ul><li>item one</li><li>item two</ul></div><div class=comments><p>" + "nice, nice, nice, nice " * 20 + "</p></div>", " ".join(["Text, with commas."] * 9) + "\nitem one\nitem two"),
    ("<article><p>cut in a tag <a href='x", "cut in a tag"),
    ("<article><script>var a='<p>no</p>';</script><p>yes &copy &am</p><form>no<input></form><aside>no</aside></article>", "yes © &am"),
    ("<div><p>a < b and c > d, said they.</p></div>", "a < b and c > d, said they."),
    (None, ""), ("", ""), ("<html></html>", ""), ("plain words", "plain words"),
    ("<article class='has-comments'><header><h1>Head</h1></header><p>" + "long " * 50000 + "</p></article>", "Head\n" + " ".join(["long"] * 50000)),
    ("<main><h2>Title</h2>loose text<div>inner</div>more</main><header class=menu>no</header><!-- <p>no</p> -->", "Title\nloose text\ninner\nmore"),
    ("<table><tr><td>a,<td>b<tr><td>c</table>", "a,\nb\nc"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_extract(spark):
    rows = [(i, None if i == 2 else f"u{i}", p, "clash", 3) for i, (p, _) in enumerate(PAGES)] + [(None, None, None, "", 0), (0, "u0", PAGES[0][0], "", 0)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], r[1], html.main_text(r[2]), len(html.main_text(r[2]))) for r in rows)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PARAGRAPH = "Words of a paragraph, with a comma, that go on for a while, number %d."


@pytest.mark.parametrize("wrappers", [0, 1, 3, 7, 12, 20])
@pytest.mark.parametrize("loose", ["", "<i>x</i>", "<span>y, </span><div>z</div>"])
def test_no_paragraph_is_lost_in_wrappers(wrappers, loose):
    """However deep the paragraphs lie, alone in their wrappers or not."""
    for n in (6, 200):
        inner = "".join(f"<div>{loose}" * wrappers + f"<p>{PARAGRAPH % k}</p>" + "</div>" * wrappers for k in range(n))
        page = f"<body><nav>menu</nav><div id=main>{inner}</div><div class='sidebar'><p>{PARAGRAPH % 999}</p></div><footer>end</footer></body>"
        got = html.main_text(page).split("\n")
        assert [x for x in got if x.startswith("Words")] == [PARAGRAPH % k for k in range(n)]
        if wrappers and "z" in loose:
            assert got.count("z") == n * wrappers


def test_names_that_are_not_furniture():
    body = "".join(f"<p>{PARAGRAPH % k}</p>" for k in range(5))
    kept = "<p class='related-work'>Related work, too.</p><div id='sharing-economy'>The sharing economy.</div><div class='social-sciences'>Social sciences.</div>"
    gone = "<div class='ad'>Buy, buy, buy.</div><div class='post cookie-banner'>We use cookies.</div><section id=comment-list><p>First!</p></section><div class=share-buttons>Share</div>"
    got = html.main_text(f"<article>{body}{kept}{gone}</article>")
    assert got.split("\n")[5:] == ["Related work, too.", "The sharing economy.", "Social sciences."]
    assert html.main_text(f"<h1>T</h1><div class=widget>{body * 3}</div>").count("Words") == 15


class Naive(HTMLParser):
    """Nested lists of (tag, attributes, children) of a well-formed page."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack = [("html", {}, [])]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [])
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def naive_text(page):
    """The method by recursion, slow and plain, for pages of div, p, article, nav, a and the names used below."""

    def tree(node):
        tag, attrs, children = node
        if tag in ("nav", "aside", "footer", "script"):
            return None
        items, run = [], []

        def flush():
            text = " ".join("".join(t for t, _ in run).split())
            if text:
                items.append((text, sum(len(t.strip()) for t, linked in run if linked)))
            run.clear()

        def flat(children, linked):
            for c in children:
                if isinstance(c, str):
                    run.append((c, linked))
                elif c[0] in ("a", "b", "i"):
                    flat(c[2], linked or c[0] == "a")
                else:
                    flush()
                    below = tree(c)
                    if below and size(below):
                        items.append(below)

        flat(children, False)
        flush()
        return {"tag": tag, "bad": attrs.get("class") in ("ad", "comments"), "items": items}

    def size(x, links=False):
        return (x[1] if links else len(x[0])) if isinstance(x, tuple) else sum(size(y, links) for y in x["items"])

    def outer(x):
        return 0 if isinstance(x, tuple) else size(x) if x["bad"] else sum(outer(y) for y in x["items"])

    def cleared(x, spared):
        if isinstance(x, dict):
            x["items"] = [cleared(y, spared) for y in x["items"] if isinstance(y, tuple) or not y["bad"] or id(y) in spared]
            x["items"] = [y for y in x["items"] if size(y)]
        return x

    def points(x):
        if isinstance(x, tuple):
            text, linked = x
            return (min(1, len(text) / 25) * (1 + text.count(",")) + min(len(text) / 100, 3)) * (1 - linked / len(text))
        return sum(points(y) * (1 if isinstance(y, tuple) or len(y["items"]) == 1 or y["tag"] == "p" else 0.5) for y in x["items"])

    def final(x):
        return (points(x) + {"article": 25, "div": 5}.get(x["tag"], 0)) * (1 - size(x, True) / size(x))

    def inner(x, path=()):
        yield x, path
        for y in x["items"]:
            if isinstance(y, dict):
                yield from inner(y, (*path, x))

    def text(x):
        return [x[0]] if isinstance(x, tuple) else [t for y in x["items"] for t in text(y)]

    root = tree(Naive(page).stack[0])
    everything = size(root)
    bare = 20 * (everything - outer(root)) < everything
    root = cleared(root, {id(x) for x, _ in inner(root) if bare and 2 * size(x) >= everything})
    if not size(root):
        return ""
    able = [(x, path) for x, path in inner(root) if x["tag"] != "p"]
    best, path = max(able, key=lambda n: final(n[0]))
    alike = [(x, p) for x, p in able if final(x) >= 0.5 * final(best)]
    peers = [(x, p) for x, p in alike if not any(any(z is x for z in q) for _, q in alike)]
    held = lambda node: sum(x is node or any(z is node for z in p) for x, p in peers)
    while path and ((len(peers) >= 3 and 2 * held(best) <= len(peers)) or len(path[-1]["items"]) == 1):
        best, path = path[-1], path[:-1]
    if not path:
        return "\n".join(text(root))
    out = []
    for x in path[-1]["items"]:
        if x is best:
            keep = True
        elif isinstance(x, tuple) or x["tag"] == "p":
            keep = size(x) > 80 and size(x, True) < 0.25 * size(x)
        else:
            keep = final(x) >= max(10.0, 0.2 * final(best))
        out += text(x) if keep else []
    return "\n".join(out)


def random_page(rng):
    said = lambda: " ".join(rng.choice(["word", "and,", "more", "tall,", "&amp;", "né", "end."]) for _ in range(rng.randint(1, 40)))

    def part(depth):
        kind = rng.random()
        if depth > 9 or kind < 0.35:
            return f"<p>{said()} <b>{said()}</b> {'<a>' + said() + '</a>' if rng.random() < 0.2 else ''}</p>"
        if kind < 0.42:
            return f"<nav><a>{said()}</a></nav>"
        if kind < 0.5:
            return f"<div class='{rng.choice(['ad', 'comments'])}'><p>{said()}</p></div>"
        if kind < 0.55:
            return said()
        tag = rng.choice(["div", "div", "div", "article"])
        return f"<{tag}>{''.join(part(depth + 1) for _ in range(rng.choice([1, 1, 2, 3, 4])))}</{tag}>"

    return "".join(part(0) for _ in range(rng.randint(1, 5)))


def test_equals_a_plain_extractor_on_random_pages():
    rng, texts = random.Random(17), 0
    for _ in range(400):
        page = random_page(rng)
        want = naive_text(page)
        assert html.main_text(page) == want, page
        texts += bool(want)
    assert texts > 300


def test_many_nested_and_stray_tags():
    t = time.perf_counter()
    for page in ("<div>a, b" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<div>a</div>" * 50_000 + "</section>" * 50_000, "<table><tr><td>" * 30_000 + "</html>" * 50_000):
        html.main_text(page)
    html.main_text("<div class=ad>x<p>a, b</p>" * 50_000)
    assert time.perf_counter() - t < 20  # seconds; minutes where the work is quadratic


def test_best_fit_is_brute_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        most = int(rng.integers(1, 40))
        lengths = rng.integers(1, most + 1, int(rng.integers(0, 60)))
        rooms = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else most) - n)
        got = token_output.best_fit(lengths, most)
        assert sorted(most - int(lengths[b].sum()) for b in got) == sorted(rooms)
        assert sorted(k for b in got for k in b) == list(range(len(lengths)))


def test_matrices_are_lossless(docs, tmp_path, spark):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    pairs = [(i, "word é " * (i % 40)) for i in range(200)] + [(1, None), (None, "x"), (3, "long text " * 3000), (3, "long text " * 3000)]
    token_output.write_matrices(token_output.packed_matrix(docs(pairs), RANKS, width=64), str(tmp_path / "m"))
    want, got = Counter(), Counter()
    for d, t in pairs:
        ids = np.asarray(encoding.encode_ordinary(t or "") + [50256], "<u4")
        want.update((d, j, a, zlib.crc32(ids[a : a + 64].tobytes())) for j, a in enumerate(range(0, len(ids), 64)))
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        got.update(token_output.unpack(r.asDict()))
        pos = np.frombuffer(r.positions, "<u4")
        assert len(r.ids) == 256 and r.cu_seqlens[-1] == r.n_tokens and all(pos[a] == 0 for a in r.cu_seqlens[:-1]) and all(np.diff(pos[: r.n_tokens])[[k for k in range(r.n_tokens - 1) if k + 1 not in r.cu_seqlens]] == 1)
    assert got == want
    assert token_output.packed_matrix(docs([]), RANKS).count() == 0


def brute_features(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {x for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def brute_votes(t):
    """The rules one by one from the text."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dup, repeated = brute_features(t)
    upper, lower = sum(c in UPPER for c in t), sum(c in LOWER for c in t)
    ended = sum(re.sub(r"[\x20\x09-\x0D]+$", "", x)[-1] in ".!?:;)\"'" for x in lines)
    tails, bars, bangs = sum(x[-1] in "#*$%&|<>" for x in w), w.count("|"), sum(x.endswith("!!") for x in w)
    top = max(Counter(w).values(), default=0)
    good_bad = [
        (50 * symbols <= n, 5 * symbols > n), (20 * tails <= n, 5 * tails > n), (bars == 0, 10 * bars > n), (5 * upper <= lower, upper > lower), (100 * bangs <= n, 5 * bangs > n),
        (20 * repeated <= n, 5 * repeated > n), (dup == 0, 3 * dup > len(lines)), (4 * top <= n, 5 * top > 2 * n), (3 * n < chars < 10 * n, chars < 2 * n or chars > 15 * n),
        (10 * ended >= 7 * len(lines), 10 * ended < len(lines)), (n >= 30, n < 10),
    ]
    return sum(3**k * (2 if bad else 1 if good else 0) for k, (good, bad) in enumerate(good_bad))


#: Letters with a case that the rules know: ASCII and the accented ones of Latin-1.
UPPER = set(map(chr, [*range(65, 91), *range(0xC0, 0xDF)]))
LOWER = set(map(chr, [*range(97, 123), *range(0xDF, 0x100)]))


#: This line and its complement are equal under any polynomial modulo 2 ** 64.
THUE = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
TEXTS = ["", None, "one", "a b c d e f g h i j k", "x y z x y z x y z x y z x y z", "l\nl\n \nl \r\nl", "é ü\x0b日本 # $ % |", "hot " * 400, "A!! B!! " * 30, "w\x1cx \x85 y z " * 5, "q " * 100000, THUE + "\n" + THUE.translate({97: 98, 98: 97}) + "\nEnds here."]


def test_quality(docs):
    pairs = list(enumerate(TEXTS)) + [(None, "x y"), (3, TEXTS[3])] + [(100 + i, f"Plain words go here, number {i}, and they end well. " * 1 + "More follow after that in a line of its own, as is usual.") for i in range(60)]
    rows = quality.score(docs(pairs)).collect()
    assert len(rows) == len(pairs)
    want = Counter((i, *brute_features(t or "")) for i, t in pairs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert Counter((r.doc_id, r.pattern) for r in rows) == Counter((i, brute_votes(t or "")) for i, t in pairs)
    by_pattern = dict(zip(*map(np.ndarray.tolist, np.unique([r.pattern for r in rows], return_counts=True))))
    good = dict(zip(by_pattern, quality.fit(np.array(list(by_pattern)), np.array(list(by_pattern.values())))))
    for r in rows:
        assert r.posterior == good[r.pattern] and r.kept == (not r.base_failed and r.posterior >= 0.5)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(r.kept for r in rows if r.doc_id is not None and r.doc_id >= 100)
    assert quality.score(docs([])).count() == 0
    # The same id with a good and a bad text: each row has its own verdict.
    more = [*pairs, (100, "bad | # $"), (100, None), (None, pairs[-1][1])]
    kept = Counter((r.doc_id, r.text) for r in quality.keep_good(docs(more)).collect())
    verdict = {}
    for r, t in zip(sorted(quality.score(docs([(k, t) for k, (_, t) in enumerate(more)])).collect(), key=lambda r: r.doc_id), [t for _, t in more], strict=True):
        verdict[t] = r.kept
    assert kept == Counter((i, t) for i, t in more if verdict[t])
    assert quality.keep_good(docs([])).count() == 0
    kept = quality.keep_good(docs(pairs))
    assert kept.columns == docs(pairs).columns and kept.count() == sum(r.kept for r in rows)


def test_em_is_the_formula():
    """One more round of plain expectation and maximisation changes nothing."""
    rng = np.random.default_rng(2)
    p = np.unique(rng.integers(0, 3 ** len(quality.RULES), 50))
    c = rng.integers(1, 100, len(p))
    good = quality.fit(p, c, rounds=4000, tolerance=0)
    digits = [[int(x) // 3**k % 3 for k in range(len(quality.RULES))] for x in p]
    size = [quality.PRIOR + sum(c * good), quality.PRIOR + sum(c * (1 - good))]
    prob = [[[(quality.PRIOR + sum(n * q for n, q, d in zip(c, w, digits) if d[k] == v)) for v in range(3)] for k in range(len(quality.RULES))] for w in (good, 1 - good)]
    for i, d in enumerate(digits):
        like = [size[y] / sum(size) * np.prod([prob[y][k][v] / sum(prob[y][k]) for k, v in enumerate(d)]) for y in range(2)]
        assert abs(like[0] / sum(like) - good[i]) < 1e-3


def test_labels():
    """On labelled documents: junk goes, and hardly any clean document that the base rules pass."""
    import duckdb

    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT text, quality FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id)").fetchall()
    f = [quality.features([(t or "").encode() for t, _ in rows[i : i + 500]]) for i in range(0, len(rows), 500)]
    f = {k: np.concatenate([x[k] for x in f]) for k in f[0]}
    v = quality.votes(f)
    p, back, n = np.unique(v, return_inverse=True, return_counts=True)
    kept = quality.fit(p, n)[back] >= quality.KEEP_AT
    base = (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])
    clean = np.array([q == 1 for _, q in rows])
    assert (kept & ~base)[clean & ~base].mean() > 0.99 and (kept & ~base)[~clean].mean() < 0.05


def test_hashes_agree_with_bytes():
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab \n\té", k=rng.randint(0, 60))) for _ in range(300)]
    t = textcore.Texts([x.encode() for x in texts])
    t.words()
    h = t.hashes()
    names = {}
    for k, x in enumerate(texts):
        for w, v in zip(re.findall(r"[^\x20\x09-\x0D]+", x), h[t.at[k] : t.at[k + 1]].tolist(), strict=True):
            assert names.setdefault(w, v) == v
    assert len(set(names.values())) == len(names)
