import pytest

from pyspark.sql import functions as F

from spanlode.llm.residue import line_evidence, normal_line, residue
from tests.conftest import rows

CASES = {
    "See {{owner_name}} for the roadmap.": "slot",
    "Maintained by ${PROJECT_DATE}.": "slot",
    "Hello %AUTHOR_NAME%, your %(release)s is ready.": "slot",
    "Ask &lt;package_date&gt; first.": "slot",
    "# [Owner Summary]\n\nText.": "slot",
    "[INSERT PROJECT TITLE HERE] keeps it.": "slot",
    "Real text here.\n\nLorem ipsum dolor sit amet elit sed magna aliqua.\n\nMore text.": "filler",
    "asdf asdf asdf asdf asdf asdf asdf asdf": "filler",
    "Sample paragraph. Replace this with your own words.": "filler",
    "<html><body><h1>502 Bad Gateway</h1></body></html>": "error",
    "Page introuvable. Erreur 404.": "error",
    'Traceback (most recent call last):\n  File "x.py", line 3, in show\nRenderError: template missing': "error",
    '{"error": {"code": 404, "message": "not found"}}': "error",
    "You need to enable JavaScript to run this app.": "notice",
    "Your session has expired. Sign in again to view the page.": "notice",
}
CLEAN = [
    'Users saw the message "You need to enable JavaScript to run this app" because the bundle was missing.',
    "When the server answers 404 Not Found, the client drops the cursor and retries.",
    "The stub renderer replaces `{{name}}` with the argument.",
    "```\nSee {{owner}} and ${X}\n```\nThe block above is the input.",
    "~~~js\nLorem ipsum dolor sit amet elit.\n~~~",
    "> Access denied.",
    "The test fixture uses lorem ipsum text so that nothing depends on real words.",
    "TODO items are kept in the tracker.",
    "Version 1.2 of release 3.4 needs the N team. See [the notes](x.md) and [Some Title](y.md).",
    "", "   \n ", None,
]


#: None of these stands in the operator as a sentence; kinds follow from slots, status phrases and the two roles of words.
UNSEEN = {
    "slot": ["Dear *|FNAME|*", "Hello %%NAME%%", "<<Insert company name>>", "Hi {{ user.first_name | default: 'x' }}", "Dear {!Contact.Name},"],
    "error": [
        "HTTP Error 503. The service is unavailable.", "502 Bad Gateway nginx/1.18.0", "Error establishing a database connection", "This site can’t be reached", "A página não foi encontrada", "ページが見つかりません",
        "The requested URL was not found on this server.", "Too many requests. Please try again later.", "We are down for maintenance", "No se puede acceder a este sitio", "Страница не найдена",
    ],
    "notice": [
        "Enable JavaScript and cookies to continue", "We're sorry but app doesn't work properly without JavaScript enabled", "Por favor, ative o JavaScript para continuar", "JavaScriptを有効にしてください",
        "Su sesión ha expirado. Inicie sesión de nuevo.", "Please wait while we verify your browser", "Please complete the captcha to continue", "Please log in to continue",
    ],
    "filler": ["Your content goes here", "Add your description here", "Dieser Text ist ein Platzhalter"],
}
TOLD = [
    'We show "Page not found" to users without the role.', "Enable cookies in the test client before the login step.", "JavaScript is a language that runs in the browser.", "Users who disable JavaScript see a plain table instead.",
    "The service was unavailable for ten minutes on Monday because of a bad deploy.", "If the page is not found, the router falls back to the index.", "Sessions expire after 30 minutes and the user has to sign in again.",
    "Not found errors are cached for a minute.", "Retry the request after the rate limit resets.", "The placeholder text is replaced at build time by the template engine.", "Session storage", "How cookies work", "Error handling", "42", "404 of them",
]


def test_lines_that_no_list_holds(spark):
    lines = [(k, x) for k, xs in UNSEEN.items() for x in xs] + [(None, x) for x in TOLD]
    df = spark.createDataFrame(lines, "want string, line string")
    got = df.select("want", "line", line_evidence(F.col("line"), normal_line(F.col("line"))).alias("kind")).collect()
    assert [(r.line, r.want, r.kind) for r in got if r.want != r.kind] == []


def test_recurrence_needs_no_least_number_of_texts(spark):
    lone = residue(texts(spark, [(1, "one", "Access denied."), (2, "two", "Access denied."), (3, "two", "Real text."), (4, "all", "Access denied."), (5, "all", "Access denied.")]))
    assert rows(lone, "id") == [(1,), (2,)]


def texts(spark, data):
    return spark.createDataFrame([(i, h, t, "x", "y") for i, h, t in data], "id long, host string, text string, line string, kind string")


@pytest.mark.parametrize("host", ["a", None])
def test_kinds(spark, host):
    got = dict(rows(residue(texts(spark, [(i, host, t) for i, t in enumerate(CASES)])), "id", "kind"))
    assert {t: got.get(i) for i, t in enumerate(CASES)} == CASES
    assert residue(texts(spark, [(i, host, t) for i, t in enumerate(CLEAN)])).collect() == []


def test_boilerplate_of_a_host_is_subtracted(spark):
    footer = "\n\nThis page needs scripts to run."
    shared = [(i, "host", f"Real text number {i}." + footer) for i in range(40)]
    assert residue(texts(spark, shared)).collect() == []
    alone = residue(texts(spark, [(i, f"host {i}", t) for i, _, t in shared]))
    assert alone.count() == 40
    own = residue(texts(spark, [*shared, (99, "host", "Access denied.")]))
    assert rows(own, "id") == [(99,)]


def test_long_text_copies_and_empty_table(spark):
    long = "".join(f"line {i} of a long text without anything in it\n" for i in range(60_000)) + "Access denied.\n"
    assert rows(residue(texts(spark, [(1, "h", long), (1, "h", long)])), "id", "lines") == [(1, 1)]
    assert residue(texts(spark, [])).collect() == []
