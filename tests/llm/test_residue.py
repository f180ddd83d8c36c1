import random
from re import _constants as C
from re import _parser

from terrane.llm.residue import _LINE, FILLER, SCRIPTS, STATUS, _is_residue, _may_match, dense, placeholders, residue, train, weak


def test_placeholders_stand_outside_code():
    assert placeholders("Dear {{name}}, your file is ready.") == 1
    assert placeholders("Dear `{{name}}` and\n```text\nHello ${x}\n```\nend") == 0
    assert placeholders("Owner: [OWNER HERE] - phone __AMOUNT__, 【请填写标题】 %title%") == 4
    assert placeholders("a 50% cut and 20% more; __init__ and x << y >> z") == 0


def test_weak_labels():
    lab = lambda t: weak(dense(t, None))
    assert lab("404 Not Found\n\nproxy/1.2") == 1
    assert lab("# Anori\n\nPlease turn on JavaScript in your browser and reload the page.") == 1
    assert lab("xxxx\nxxxxxxx\nxxxx") == 1
    assert lab("Users saw 'page not found' because the route was renamed, and we added a redirect.\nThe rest is a long and quiet report on the rows of the table.") == 0


def rows():
    hosts = [f"h{i}" for i in range(10)]
    good = [(i, f"The table {i} of Anori keeps its rows while the writer waits, and nothing else happens in the night. " * 6, hosts[i % 10]) for i in range(150)]
    bad = [(1000 + i, f"Error 50{i % 4}: the page is not found. Access denied, request {i}.\n" * (1 + i % 3), hosts[i % 10]) for i in range(60)]
    return good, bad


def test_classifier_holds_on_unseen_hosts(spark):
    good, bad = rows()
    model, figures = train([(t, None, h) for _, t, h in good + bad])
    assert figures["f1"] >= 0.95 and figures["tested"] > 0
    talk = (2000, "A 404 usually means that the chunk was deleted. " + good[0][1] * 3, "h1")
    hole = (2001, good[0][1] + "\nDear {{customer}}, hello.", "h1")
    data = good + bad + [talk, hole, (2002, None, "h1"), (2003, "", None), (None, "Error 500", "h1"), bad[0], (2004, good[1][1] * 900, None)]
    df = spark.createDataFrame([(*x, "n.md", 0.5) for x in data], "doc_id long, text string, source string, document_name string, score double")
    got = {r.doc_id for r in residue(df).where("residue").collect()}
    assert {i for i, _, _ in bad} <= got and got - {i for i, _, _ in bad} <= {2001}


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "404 Not Found", "a", "x")], "doc_id long, text string, source string, document_name string")
    assert [r.residue for r in residue(df).collect()] == [True]
    assert residue(df.limit(0)).count() == 0


def sample(r, items):
    """A random text for a parsed pattern; anchors and assertions are ignored."""
    out = ""
    for op, v in items:
        if op is C.LITERAL:
            out += r.choice([chr(v), chr(v).upper()])
        elif op is C.ANY:
            out += r.choice("ab 1.")
        elif op is C.IN:
            kind, x = r.choice(v)
            out += chr(x) if kind is C.LITERAL else chr(r.randint(*x)) if kind is C.RANGE else {C.CATEGORY_DIGIT: "7", C.CATEGORY_SPACE: " ", C.CATEGORY_WORD: "k", C.CATEGORY_NOT_WORD: "-"}.get(x, "q")
        elif op is C.BRANCH:
            out += sample(r, r.choice(v[1]))
        elif op is C.SUBPATTERN:
            out += sample(r, v[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(sample(r, v[2]) for _ in range(r.randint(v[0], min(v[1], v[0] + 4))))
    return out


def test_every_match_passes_the_filter():
    r, matched = random.Random(6), 0
    for p in (*STATUS, *SCRIPTS, *FILLER):
        tree = _parser.parse(p)
        own = 0
        for _ in range(3000):
            line = sample(r, tree).strip()
            if _LINE.search(line):
                own += 1
                assert _may_match(line) and _may_match(line).search(line), (p, line)
        assert own > 300, (p, own)
    for line in ("405 Method Not Allowed", "413 Request Entity Too Large", "521 Service is down", "525 - Gateway problem", "400 - Bad input", "######", "······", "* * * *", "x x x x x", "acce\u017fs denied", "Internal \u017ferver Error", "ACCESS DEN\u0130ED"):
        assert _LINE.search(line) and _is_residue(line), line
    assert weak(dense("413 Request Entity Too Large\n\nproxy/1.2", None)) == 1


def test_long_lines_are_read_whole():
    lab = lambda t: weak(dense(t, None))
    error = "<html><head><style>" + "p{margin:0} " * 60 + "</style></head><body><h1>503 Service Unavailable</h1><p>Something went wrong on our side.</p><p>" + "Scheduled maintenance is running, we will be back shortly. " * 8 + "</p></body></html>"
    script = "<div class='a'>" + "</div><div>" * 40 + "<noscript>You need to enable JavaScript to run this app. Please turn on JavaScript and reload.</noscript></div>"
    heading = "Annual overview of the council and the people who keep its ledger through every season of the year, with news and contact "
    real = "The writer waits while the table keeps its rows, and the keeper counts the chests in the night. "
    assert min(map(len, (error, script))) > 400
    assert lab(error) == 1 and lab(script) == 1
    assert lab(heading + "lorem dolor amet elit tempor incididunt labore magna aliqua veniam " * 40) == 1
    assert lab("wait, " * 400 + "error 500") == 0
    assert lab(real * 20 + "The server said error 500. " + real * 20) == 0
    assert lab(real * 40) == 0


#: Pages and spans that no phrase of the weak labels matches.
UNSEEN_PAGES = [
    "Gone\n\nThe requested resource was removed from this host.",
    "The requested URL /a/b was not located on this machine. Error in the request.",
    "Your browser has script execution off. Switch scripts on and reload this page.",
    "Cette page exige l'exécution de scripts. Veuillez les activer et recharger la page.",
    "Zugang nicht möglich: Ihre Rechte reichen für diese Seite nicht aus. Bitte melden Sie sich an.",
    "您要找的内容已经移走，请返回首页。",
    "Request rejected by the gateway. Reason: upstream reset. Reference 99123.",
    "amet dolor lorem ipsa veniam tetur elitas magnas incidu sitque consec adipi labore quisno.",
]
UNSEEN_SPANS = ["Dear {customer_name}, thank you.", "Hello {{first-name|upper}}, welcome.", "Contact: <OWNER_NAME>, room <ROOM>.", "价格：【请补全金额】元。", "Total: ((amount_due)) to pay.", "Dear %%name%%, hello."]
REAL = [
    "The error page of the portal was redesigned in spring; visitors now find a search field and a phone number there. " * 3,
    "In Python, f-strings such as `{name}` are filled at run time (see section 3), and lists [a, b] keep their order. " * 3,
    "Der Fehler 500 trat im Mai selten auf (3 Fälle), weil die Last gering war. Danach blieb der Dienst ruhig. " * 3,
    "报告说明了错误码的含义，并列出了三个月内的统计（见表2）。服务一直稳定，没有新的问题。" * 3,
]


def test_phrases_outside_the_lists(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(trim(text)) > 0").select("text", "document_name", "source").limit(4000).collect()]
    assert not any(weak(dense(t, None)) for t in UNSEEN_PAGES[:7] + UNSEEN_SPANS)
    model, figures = train(rows)
    assert min(figures["f1"], figures["f1_pages"], figures["f1_spans"]) >= 0.98
    page, _ = model.scores(UNSEEN_PAGES, ["x.html"] * len(UNSEEN_PAGES))
    _, hole = model.scores([REAL[0] + t for t in UNSEEN_SPANS], [None] * len(UNSEEN_SPANS))
    real = [max(x) for x in zip(*model.scores(REAL, [None] * len(REAL)))]
    print([round(float(x), 2) for x in (*page, *hole, *real)])
    assert (page > 0.5).mean() >= 0.6 and (hole > 0.5).mean() >= 0.6 and max(real) <= 0.5
