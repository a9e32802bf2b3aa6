"""Cases in which an operator once did less than its whole job."""

import random
import zlib

import pytest

from evalmill.llm import scoring, sharding
from evalmill.llm.pages import main_text


def test_rare_words_have_emissions_of_their_own(spark):
    """Two words of the same ending and count, far below a 20,000th of the tokens, stand in texts of different topics."""
    random.seed(4)
    ids = {h: iter([i for i in range(4000) if (zlib.crc32(str(i).encode()) % 5 == 1) == h]) for h in (True, False)}
    topics = {t: [f"{t}{i}" for i in range(60)] for t in "ab"}

    def text(topic, *rare):
        words = random.choices(topics[topic], k=400)
        for w in rare:
            words.insert(200, w)
        return " ".join(words)

    docs = [(next(ids[False]), text(t, *([f"{t}{t}qqq"] if n < 2 else []))) for n in range(60) for t in "ab"]
    same = text("a")
    fresh = {w: next(ids[True]) for w in ("aaqqq", "bbqqq")}
    docs += [(i, same + " " + w) for w, i in fresh.items()]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    scored, dealt = ({r["doc_id"]: r for r in scoring.score_documents(table.repartition(n), states=2, rounds=4).collect()} for n in (1, 6))
    assert all(abs(scored[i]["score"] - dealt[i]["score"]) < 1e-3 * abs(scored[i]["score"]) for i in scored)
    own, other = (scored[fresh[w]] for w in ("aaqqq", "bbqqq"))
    assert own["base_score"] == other["base_score"] and own["train_tokens"] > 2 * 20_000
    assert own["score"] > other["score"] + 0.05


STORY = "".join(f"<p>Paragraph {i} of the story goes on for quite a while, so that nobody takes it for a label.</p>" for i in range(8))
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id='aspnetForm'><div class='menu'>{MENU}</div><article><h1>Title</h1>{STORY}</article><input></form></body>",
        f"<body><div class='sidebar-right'><main><h1>Title</h1>{STORY}</main><aside>{MENU}</aside></div></body>",
        f"<body><div class='page right-sidebar'><div><h1>Title</h1>{STORY}</div><div class='sidebar'>{MENU}</div></div></body>",
        f"<body><div><h1>Title</h1>{STORY}</div><div><article class='card'><p>Read this other text too.</p></article></div></body>",
        f"<body><h1>Title</h1><div>{STORY}</div></body>",
    ],
)
def test_articles_in_common_layouts(page):
    text = main_text(page)
    assert "Title" in text and all(f"Paragraph {i} of" in text for i in range(8)) and "About" not in text


def test_boilerplate_around_an_article_still_goes():
    comments = f"<div class='comments'><article class='comment'>{STORY.replace('story', 'answer') * 3}</article></div>"
    form = "<form><p>Sign up for our letter with your address and your name, please.</p></form>"
    text = main_text(f"<body><article><h1>Title</h1>{STORY}</article>{comments}{form}</body>")
    assert text.startswith("Title") and text.count("Paragraph") == 8 and "answer" not in text and "Sign up" not in text


@pytest.mark.parametrize("place", [0, 0.3, 0.98, 1])
def test_a_hot_group_leaves_no_shard_empty(spark, monkeypatch, place):
    monkeypatch.setattr(sharding, "SUMS", 128)
    random.seed(8)
    keys = sorted({random.getrandbits(64) - (1 << 63) for _ in range(4000)})
    sizes = [random.randint(1, 100) for _ in keys]
    hot = min(int(place * len(keys)), len(keys) - 1)
    sizes[hot] = sum(sizes) // 2
    table = spark.createDataFrame(list(zip(keys, sizes)), "key bigint, size bigint")
    _, capacity = sharding.cut_hashes(table, 16)
    cuts = sharding.even_cuts(table, capacity, 16)
    load = [0] * 16
    for k, size in zip(keys, sizes):
        load[sum(c <= k for c in cuts)] += size
    fair = (sum(load) - sizes[hot]) / 15
    assert max(load) == capacity and min(load) > 0
    # a few groups behind the hot one take a shard of their own, and its part goes to the one before
    assert sum(x > 2 * fair for x in load) == 1 and sum(x < 0.8 * fair for x in load) <= 2


def test_even_cuts_never_exceed_the_capacity():
    random.seed(9)
    for n in range(400):
        sizes = [random.choice([1, 5, random.randint(1, 3000)]) for _ in range(random.randint(1, 60))]
        shards = random.randint(1, 16)
        capacity = sharding.smallest_capacity(sizes, shards)
        pieces = [sharding.Piece(i, 0, x, 1) for i, x in enumerate(sizes)]
        large = sorted(((i, x) for i, x in enumerate(sizes)), key=lambda p: -p[1])[:shards]
        ends, todo = sharding.even_ends(pieces, capacity, shards, large)
        assert not todo and ends[-1] == len(sizes) and len(ends) <= shards
        assert max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends)) <= capacity
