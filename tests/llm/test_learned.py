"""Learned operators on held-out documents, and planted cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import html, langid, quality, toxicity
from llm_cases import documents, prose

MIDDLE = "/root/testdata/sf0.01"
#: Groups of a language and source hold some ten documents in the middle table, too few to judge by.
LARGE = "/root/testdata/sf0.1"


def test_toxicity_of_held_out_documents(spark):
    """A lexicon that only the labels tell; clean documents stay clean."""
    bad = ["grubblo", "snarvil", "krotzen"]
    rows, labels = [], []
    for k in range(1200):
        text = prose(k, 60, "fr" if k % 2 else "en")
        toxic = k % 5 == 0
        if toxic:
            words = text.split()
            for j in range(4):
                words.insert(7 * j + k % 7, bad[(k + j) % 3] + ["", "s", "er"][k % 3])
            text = " ".join(words)
        rows.append((k, text, "en", "s"))
        labels.append((k, int(toxic)))
    found = toxicity.toxicity_scores(spark, documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in found if r["held_out"]]
    assert 300 < len(held) < 500
    assert all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all(0 <= r["score"] <= 1 and (r["score"] >= toxicity.THRESHOLD) == bool(r["predicted"]) for r in found)


def test_label_model_finds_accuracies_and_pairs():
    pick = np.random.default_rng(4)
    size, prior = toxicity.LEXICON_VOTERS + len(toxicity.PATTERNS), 0.2
    toxic = pick.random(60_000) < prior
    rates = np.where(np.arange(size) < 8, 0.5, 0.3), np.where(np.arange(size) < 8, 0.05, 0.3)
    votes = np.where(toxic[:, None], pick.random((60_000, size)) < rates[0], pick.random((60_000, size)) < rates[1])
    votes[:, 1] = np.where(pick.random(60_000) < 0.6, votes[:, 0], votes[:, 1])  # two voters that copy
    counts = votes.astype(float).T @ votes
    model = toxicity.LabelModel(len(votes), counts, prior)
    assert np.abs(model.toxic[2:8] - 0.5).max() < 0.08 and np.abs(model.clean[2:8] - 0.05).max() < 0.03
    assert {tuple(sorted(pair)) for pair in model.parents.items()} == {(0, 1)}
    posterior = np.array([model.posterior(v) for v in votes[:3000].astype(float)])
    assert posterior[toxic[:3000]].mean() > 0.8 and posterior[~toxic[:3000]].mean() < 0.3


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in langid.languages(spark, docs).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_quality_against_labels(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    found = [r for r in quality.quality_verdicts(spark, docs).collect() if r["doc_id"] in good and not r["base_failed"]]
    kept = [r["kept"] for r in found if good[r["doc_id"]]]
    rejected = [not r["kept"] for r in found if not good[r["doc_id"]]]
    assert np.mean(kept) > 0.99 and np.mean(rejected) > 0.9


def _vectors(spark, values, groups):
    """Vectors in the integers of the fit, with groups of one language."""
    rows = [(k, g, "l", False, *map(int, np.round(x * quality.SCALE))) for k, (x, g) in enumerate(zip(values, groups))]
    columns = ["k int", "group string", "wider string", "base_failed boolean", *[f"x{i} bigint" for i in range(5)]]
    return spark.createDataFrame(rows, ", ".join(columns))


def _rejected(spark, vectors):
    return {r["k"] for r in quality.judged(vectors, quality.fit(spark, vectors)).where("not kept").collect()}


def test_quality_rejects_junk_in_one_cluster(spark):
    """A fifth of a hot source lies in one place; the estimate of all documents hides it."""
    pick = np.random.default_rng(1)
    floors = np.array(list(quality.FLOORS.values()))
    clean = np.array([1.6, 1.0, 0.3, 0.3, 0.4])
    values = clean + pick.normal(size=(6000, 5)) * floors * 1.5
    values[:1200] = clean + 12 * floors + pick.normal(size=(1200, 5)) * floors * 0.2
    assert _rejected(spark, _vectors(spark, values, ["g"] * 6000)) == set(range(1200))


def test_quality_by_the_covariance(spark):
    """Word lengths and capitals go together: rows against the trend are out, farther ones along it are in."""
    pick = np.random.default_rng(2)
    along = pick.normal(size=4000)
    values = np.tile([1.6, 1.0, 0.0, 0.0, 0.35], (4000, 1))
    values[:, 0] += 0.08 * along + 0.01 * pick.normal(size=4000)
    values[:, 4] += 0.04 * along + 0.005 * pick.normal(size=4000)
    values[0, [0, 4]] = 1.6 + 0.12, 0.35 - 0.06
    values[1, [0, 4]] = 1.6 + 0.28, 0.35 + 0.14
    vectors = _vectors(spark, values, ["g"] * 4000)
    assert _rejected(spark, vectors) == {0}
    parameters = quality.fit(spark, vectors)
    without = parameters.withColumns({f"c{i}{j}": F.lit(0.0) for i, j in quality._pairs() if i != j})
    spread = F.sqrt(F.col("c44") ** 2 + F.col("c40") ** 2)
    alone = without.join(parameters.select("group", spread.alias("s")), "group").withColumn("c44", F.col("s")).drop("s")
    passed = {r["k"]: r["kept"] for r in quality.judged(vectors, alone).collect()}
    assert passed[0] and not passed[1]  # without covariances the verdicts change sides


def test_quality_per_source(spark):
    """What is usual in one source is rejected in another; small sources lean on their language."""
    pick = np.random.default_rng(3)
    groups = ["a"] * 900 + ["b"] * 300 + ["c"] * 3
    values = np.array([1.6, 0.0, 0.0, 0.0, 0.4]) + pick.normal(size=(1203, 5)) * [0.03, 0, 0, 0, 0.015]
    values[900:1200, 0] += 0.6
    values[0, 0] = values[900, 0]
    values[1, 0] = 1.75
    assert _rejected(spark, _vectors(spark, values, groups)) == {0}


def test_quality_finds_the_smallest_determinant(spark):
    """No concentration from a hundred random samples ends below the result."""
    pick = np.random.default_rng(4)
    centres = np.array([[1.6, 1.0, 0.3, 0.3, 0.4], [1.9, 2.5, 0.6, 0.5, 0.55]])
    values = centres[(np.arange(900) % 5 > 2).astype(int)] + pick.normal(size=(900, 5)) * [0.05, 0.5, 0.08, 0.08, 0.02]
    vectors = _vectors(spark, values, ["g"] * 900)
    found = quality.fit(spark, vectors).first()
    size = sum(2 * np.log(found[f"c{i}{i}"]) for i in range(5))
    x, least, share = np.round(values * quality.SCALE) / quality.SCALE, np.inf, 675 / 695
    middle = np.median(x, axis=0)
    spreads = np.subtract(*np.quantile(x, [0.75, 0.25], axis=0)) / 1.349
    for _ in range(100):
        mean, covariance = x[pick.choice(900, 6, replace=False)], None
        mean, covariance = mean.mean(axis=0), np.cov(mean.T) + np.diag([1e-6] * 5)
        for _ in range(30):
            apart = x - mean
            near = x[np.argsort((apart * np.linalg.solve(covariance, apart.T).T).sum(axis=1))[:675]]
            shift = near.mean(axis=0) - middle
            mean = middle + share * shift
            covariance = share * quality.CONSISTENCY * np.cov(near.T, bias=True) + share * (1 - share) * np.outer(shift, shift)
            covariance += (1 - share) * np.diag(spreads**2)
        least = min(least, np.linalg.slogdet(covariance)[1])
    assert size < least + 0.05


BODY = "<p>This is a paragraph of the article, long enough to count as text.</p><p>It has a second one &amp; a third.</p><p>x</p>"
TEXT = "This is a paragraph of the article, long enough to count as text.\nIt has a second one & a third.\nx"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<nav><a>m</a></nav><article>{BODY}</article><footer>f</footer>", TEXT),
        (f"<header>Site name</header><main>{BODY}</main><aside>side</aside>", TEXT),
        (f"<div class='menu'>m</div><div id=content>{BODY}</div><div class='cookie-banner'>We use cookies</div>", TEXT),
        (f"<body class='with-sidebar'><div id='sidebar'>s</div>{BODY}<section class=comments><p>nice read, thanks for it</p></section>", TEXT),
        (f"<article class='post has-comments'>{BODY}<div class='ad'>buy</div><form>f</form></article>", TEXT),
        (f"<nav>never closed<article>{BODY}", TEXT),
        (f"<script>var a = '<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><article>{BODY}</article>", TEXT),
        (f"<article>{BODY}</article><article class='comment'><p>{'a long reader comment ' * 40}</p></article>", TEXT),
        ("<article><p>a\n\t b&nbsp;c</p><p>&#233;&lt;p&gt;</p></article>", "a b c\né<p>"),
        ("<article><p>cut off he", "cut off he"),
        ("", ""),
        (None, ""),
        ("<nav>only a menu</nav>", ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='cookie-banner'>Accept all cookies</div><p>We are closed on Monday.</p>", "We are closed on Monday."),
        ("<p>We are closed.</p><div class='comments'><p>Nice, thanks!</p></div><div class='sidebar'>More</div>", "We are closed."),
        ("<article><p>Short.</p></article><div class='comments'><p>Nice, thanks!</p></div>", "Short."),
        (f"<div>{BODY}<ul><li><a href=x>A reference that is made of a link</a></li></ul>{BODY}</div>", f"{TEXT}\nA reference that is made of a link\n{TEXT}"),
        (f"<ul><li><a href=x>Home</a></li></ul>{BODY}<ul><li><a href=x>Other pages</a></li></ul>", TEXT),
        (f"<div id='site-search'>{BODY}</div>", TEXT),
        (f"<div class='comments'><p>{'a long reader comment ' * 40}</p></div>", ""),
        (f"{BODY}<div class='comments'><p>{'a long reader comment ' * 90}</p></div>", TEXT),
    ],
)
def test_short_pages_links_and_wrappers(page, text):
    assert html.main_text(page) == text


def _by_rule(lengths, window, surge):
    """Line by line: inside from a surge of text on until no text follows in the window."""
    out, inside = [], False
    for k in range(len(lengths)):
        ahead = sum(lengths[k : k + window])
        inside = lengths[k] > 0 and ahead >= surge if not inside else ahead > 0
        out.append(inside and lengths[k] > 0)
    return out


def test_line_blocks_match_the_rule():
    pick = np.random.default_rng(5)
    for _ in range(500):
        lengths = (pick.integers(0, 90, pick.integers(0, 30)) * (pick.random() < pick.random(1))).tolist()
        lengths = [int(x) * int(pick.random() < 0.6) for x in lengths]
        for window, surge in ((1, 40), (3, 80), (4, 1)):
            assert html._kept(lengths, window, surge) == _by_rule(lengths, window, surge)


LONG = "A part of the article with a name, long enough that its block sum alone is a surge of the text."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article>{BODY}<section id='related-work'><h2 id='search-methods'>Search</h2><p>short</p></section></article>", f"{TEXT}\nSearch\nshort"),
        (f"<article>{BODY}<section id='Social_structure'><p>short</p></section><p id='notice-3'>a</p></article>", f"{TEXT}\nshort\na"),
        (f"<article>{BODY}<div class='form-of-government'><p>short</p></div><h3 class=related>b</h3></article>", f"{TEXT}\nshort\nb"),
        (f"<article>{BODY}<section class='social'><p>{LONG}</p></section></article>", f"{TEXT}\n{LONG}"),
        (f"<article>{BODY}<section class='social'><a>share</a></section><section class=comments><p>{LONG}</p></section></article>", TEXT),
        (f"<article>{BODY}<section class='social'><section><p>a</p></section><p>b</p></section><p>c</p></article>", f"{TEXT}\nc"),
        (
            "<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> and "
            "<label>one</label>, <object data=f>two</object></p></article>",
            "so x=1 and one, two",
        ),
    ],
)
def test_main_text_of_named_parts(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article>{BODY}</article><article><p>second</p></article>", f"{TEXT}\nsecond"),
        (f"<div itemprop=articleBody>{BODY}</div><nav>n</nav><div role=article><p>second</p></div>", f"{TEXT}\nsecond"),
        (f"<article>{BODY}</article><section class=comments><article><p>{LONG * 9}</p></article></section>", TEXT),
        (f"<section id=post-comments><article><p>{LONG * 9}</p></article></section><article>{BODY}</article>", TEXT),
        (f"<article>{BODY}</article><aside><p>more</p><article><p>{LONG * 9}</p></article><p>{LONG * 9}</p></aside>", TEXT),
        (f"<div class='ad'>{LONG}<article>{BODY}</article><article><p>second</p></article></div>", f"{TEXT}\nsecond"),
        (
            f"<article>{BODY}<div class=comments><article>a</article><article>b</article></div><p>end</p></article>",
            f"{TEXT}\nend",
        ),
        (f"<div itemprop=articleBody>{BODY}<form><div>a</div>b</form><p>end</p></div>", f"{TEXT}\nend"),
        (f"<article>{BODY}</article><article><h2><a href=x>{LONG}</a></h2></article>", TEXT),
        (f"<article><ul><li><a href=x>{LONG}</a></li><li><a href=y>b</a></li></ul></article>", f"{LONG}\nb"),
        (f"<p>{LONG * 4}</p><article>{BODY}</article><p>{LONG}</p>", f"{LONG * 4}\n{TEXT}"),
        (f"<p>{LONG}</p><article><p>a</p></article><p>{LONG}</p>", "a"),
    ],
)
def test_main_text_of_several_articles(page, text):
    assert html.main_text(page) == text


def test_main_text_of_the_given_pages(spark):
    """The given pages mark their article; its text, block by block, is what is wanted."""
    import html as entities
    import re

    for row in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.DOTALL)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert html.main_text(row["html"]) == "\n".join(filter(None, blocks))
