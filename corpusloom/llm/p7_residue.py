"""Problem 7: template residue, filler, error pages and demands for scripts.

Method: character n-gram models of filler, of notices (errors, access, scripts) and of natural prose score windows of each
line of the main body; the likelihood ratio against prose and against an even background localises residue, and a page goes
out by the share of its main body that residue covers, or for one paragraph of filler. The prose model counts every line of
all main bodies; the filler and notice models begin with the public wordings below and learn from the pages in rounds:
lines that the models are sure of pass from the prose to the model they belong to, so wordings that stand beside known ones
become known. Only n-gram counts meet (three tables of SLOTS numbers). Unfilled placeholders are a grammar, unless the
sentence speaks about templates.

Defined results: null ids go, a repeated page_id counts once (latest delivery); null, empty and blank content is no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import p4_main_body
from corpusloom.session import cut

N, SLOTS = 4, 1 << 16
WINDOW = 160  #: characters of a window
MIX = 0.9
SURE, LIKELY, WEAK = 0.6, 0.25, 0.1  #: mean log-likelihood ratio per character
COVER = 0.4
ROUNDS = 3  #: rounds of learning
NEAR = -1.0  #: lines below this ratio under the first models cannot become sure ones and are left out of the rounds

# Public wordings of filler (the usual dummy Latin and its source, words typed to fill a place, notes of
# templates) and of notices (HTTP reasons, servers, run-time systems, browsers, sign-in and robot checks).
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit curabitur vel hendrerit libero eleifend blandit nunc ornare odio
ut orci gravida imperdiet nullam purus lacinia pretium quis congue praesent sagittis laoreet auctor mauris velit eros dictum proin
accumsan sapien massa volutpat venenatis sed molestie lacus quisque porttitor ligula dui mollis tempus magna vestibulum turpis diam
tincidunt condimentum enim sodales hac habitasse platea dictumst aenean neque fusce augue leo eget semper mattis tortor scelerisque
nulla interdum tellus malesuada rhoncus porta sem aliquet suspendisse potenti vivamus luctus fringilla erat donec justo vehicula
ultricies varius ante primis faucibus ultrices posuere cubilia curae etiam cursus aliquam quam dapibus nisl feugiat egestas class
aptent taciti sociosqu litora torquent conubia nostra inceptos himenaeos phasellus nibh pulvinar vitae urna iaculis lobortis nisi
viverra arcu morbi pellentesque metus commodo facilisis felis tristique ullamcorper placerat convallis sollicitudin integer rutrum
duis est bibendum pharetra vulputate maecenas fermentum consequat suscipit habitant senectus netus fames euismod lectus elementum
tempor risus cras finibus efficitur maximus pariatur cillum fugiat voluptate excepteur sint occaecat cupidatat proident sunt culpa
officia deserunt mollit anim laborum exercitation ullamco laboris aliquip veniam nostrud labore dolore aliqua"""
FILLER_SEEDS = """
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae.
Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli appellantur. Hi omnes lingua, institutis, legibus inter se differunt.
Arma virumque cano, Troiae qui primus ab oris Italiam, fato profugus, Laviniaque venit litora, multum ille et terris iactatus et alto vi superum saevae memorem Iunonis ob iram.
This is sample text. This is dummy text. This is placeholder text. Your text here. Your content goes here. Add your text here. Enter your text here. Insert your content here. Replace this text with your own. Edit this text. Click here to edit. Write something about yourself here.
Type your heading here. Heading goes here. Title goes here. Subtitle goes here. Subheading. Sample heading. Heading 1. Heading two. Button text. Button label. Link text. Image caption. Image placeholder. Picture caption. Sample image. Text block. This is a text block.
Write a short introduction here. Add a short description here. Add a few lines about the product here. Describe your product in two or three sentences. Replace this paragraph with your own words.
Sample page. This is an example page. Dummy content for testing the layout, do not publish. For layout only. To be replaced before launch. Remove this text before publishing. Remove before going live. End of sample text. Text to follow. Copy to come. Content coming soon. Under construction.
test test test. testing testing one two three. foo bar baz qux. foo foo bar bar. blah blah blah. asdf asdf asdf. asdf jkl qwerty. xxx xxx xxxx. abc abc abc. aaa bbb ccc. dummy dummy dummy. foobar foo bar blah test asdf xxx abc dummy
"""
NOTICE_SEEDS = """
Error 404. 404 Not Found. Not found. Page not found. File not found. 410 Gone. The requested URL was not found on this server. The page you are looking for does not exist. The page you requested could not be found. The page no longer exists. This page is no longer available. This page isn't available. Sorry, we can't find the page you are looking for. Sorry, we could not find that page. No such page. No such file or document. The requested document does not exist.
It may have been moved, renamed or deleted. The link may be broken or mistyped. Please check the address and the spelling. Try searching instead. Use the search box. Return to the home page. Go back to the start page. Oops! That page can't be found. Oops! Something went wrong. Whoops, looks like something went wrong.
Error 500. HTTP 500. 500 Internal Server Error. 501 Not Implemented. 502 Bad Gateway. 503 Service Unavailable. 504 Gateway Timeout. Service unavailable. The server encountered an internal error and was unable to complete your request. The service is temporarily unavailable. The server did not respond in time. The server took too long to respond. We are having technical difficulties. Our team has been notified. Our engineers have been notified. Please try again later. Please try again in a few minutes.
Down for maintenance. Scheduled maintenance. Down for planned maintenance work. We are currently undergoing maintenance. The service will be back at 10:00. We are unable to show this page at the moment. We are unable to process your request right now. An error occurred while processing your request. Reference number 12345. Incident number 12345. Error code 12345.
Connection refused. Connection timed out. Connection reset by peer. Connection to the database server was refused. This site can't be reached. Unable to connect. Your connection is not private. The certificate has expired. Secure connection failed. The certificate is out of date or not valid.
Unhandled exception. Exception in thread "main" java.lang.NullPointerException at com.example.app.Main.run(Main.java:12). Caused by: java.lang.IllegalStateException. Traceback (most recent call last): File "app.py", line 12, in main. KeyError: missing key. IndexError: list index out of range. Index out of range. TypeError: cannot read property of undefined. InvalidCastException: bad cast. null value. at module.function (app.js:12:34).
Fatal error: uncaught Error: call to undefined function in /var/www/html/index.php on line 12. Warning: include(config.inc): failed to open stream: no such file or directory in /var/www/html/index.php on line 34. Warning: cannot modify header information on line 12. Notice: undefined index on line 7. Parse error: syntax error on line 3. SQL error: you have an error in your SQL syntax near. Query failed: relation does not exist. Query failed: the table is missing. Database error. Error establishing a database connection. Deadlock found.
Error 403. 403 Forbidden. 401 Unauthorized. Access denied. Permission denied. You do not have permission to view this page. You are not authorised to access this page. You are not allowed to view this page. You have no right to open this page. Access to this resource on the server is denied. Your request was blocked. Request blocked. 429 Too Many Requests. Too many requests from your network, please slow down. Ray ID: 5f3a. Request id 5f3a. Check id 5f3a.
Session expired. Session timed out. Your session has expired. Your session has ended. Please log in again. Please sign in to continue. Log in again to continue. You have been logged out. You have been signed out after 15 minutes of inactivity. Sign-in has expired. You must be logged in to view this page.
Please enable JavaScript. You need to enable JavaScript to run this app. You need to turn on JavaScript. This page requires JavaScript. This page only works with JavaScript or scripts switched on. JavaScript is disabled in your browser. Please enable scripts and reload the page. noscript: the content cannot be shown because scripting is switched off. Please change the settings of your browser and reload. Please enable cookies. Please enable cookies and JavaScript, then refresh the page. Cookies are required. Cookies are disabled. Your browser does not accept cookies. Allow JavaScript for this site if nothing happens.
Your browser is out of date. Your browser is too old. Your browser is not supported. Please update your browser. Update it or enable active content. Checking your browser before accessing the site. One moment, please. Just a moment... Loading... Please wait. Verify that you are human. Prove that you are not a robot. I am not a robot. Please complete the security check to access. Complete the captcha to continue.
Page introuvable. Page non trouvée. La page demandée n'existe pas. L'adresse demandée n'existe plus. Erreur interne du serveur. Accès refusé. Accès interdit. Service indisponible. Service temporairement indisponible. Veuillez réessayer plus tard. Veuillez activer JavaScript pour afficher cette page. Ce contenu nécessite JavaScript. Veuillez accepter les cookies. Votre session a expiré. Veuillez vous reconnecter. Connexion refusée.
Halaman tidak dijumpai. Halaman yang diminta tidak wujud. Ralat pelayan dalaman. Capaian ditolak. Akses dinafikan. Perkhidmatan tidak tersedia. Sila cuba sebentar lagi. Sila cuba lagi kemudian. Sila aktifkan JavaScript untuk melihat kandungan ini. Sesi anda telah tamat. Sila log masuk semula.
Seite nicht gefunden. Interner Serverfehler. Zugriff verweigert. Bitte aktivieren Sie JavaScript. Bitte versuchen Sie es später erneut. Página no encontrada. Error interno del servidor. Acceso denegado. Por favor, active JavaScript. Inténtelo de nuevo más tarde.
"""
PLACEHOLDER = re.compile(
    r"\{\$?[A-Za-z]\w*\}|\{\{\s*[A-Za-z][\w. ]*\s*\}\}|\$\{\s*[A-Za-z]\w*\s*\}|%%\s*[A-Za-z]\w*\s*%%|(?<![\w_])__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*__(?![\w_])|"
    r"@@\s*[A-Za-z]\w*\s*@@|<%=?\s*[A-Za-z][\w. ]*\s*%>|\[\[\s*[A-Za-z][\w ]*\s*\]\]|\[(?:INSERT|ENTER|ADD|YOUR) [A-Z][A-Z _]*\]|\[[A-Z][A-Z _]* (?:TO BE ADDED|HERE|TBC|TBD)\]|"
    r"<(?:INSERT )?[A-Z][A-Z _]+ here>|(?<!\w)#[A-Z][A-Z_]{2,}#(?!\w)|&lt;\s*[A-Za-z][\w ]*\s*&gt;", re.I)
# Words by which a sentence speaks about templates; the first kind counts twice.
ABOUT = re.compile(r"\b(?:(placeholders?|templates?|render\w*|tokens?|variables?|syntax|markup|merge fields?|developers?|programmers?|stands? for|curly|braces|brackets)|(examples?|drafts?|editors?|fields?|manuals?|documentation|fill\w*|lists?|writes?|written|replaced))\b", re.I)
ABOUT_LEAST = 4
_HINT = re.compile(r"[{<\[#_@%$&]")
_LETTER = re.compile(r"[^\W\d_]")
_SERIAL = re.compile(r"[0-9a-f]{6,}|\w{1,8} [0-9a-f]{4,}")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def grams(text: str) -> np.ndarray:
    """Slots of the character n-grams of a text, lower case, figures as 0."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c[(c >= 48) & (c <= 57)] = 48
    if len(c) < N:
        return np.empty(0, np.int64)
    h = c[: len(c) - N + 1].copy()
    for i in range(1, N):
        h = h * np.uint64(1_000_003) + c[i : len(c) - N + 1 + i]
    h ^= h >> np.uint64(31)
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(48)).astype(np.int64)


def line_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the n-grams of all lines, their number in each line): `grams` of each line in one go."""
    if not lines:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat = grams(" \x00 ".join(lines))
    length = np.array([len(x.lower()) for x in lines], np.int64) + 2  # with the blank before and after
    size = np.maximum(length - (N - 1), 0)
    start = np.cumsum(length + 1) - (length + 1)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return flat[at], size


class Models:
    """Log-probabilities of n-gram slots for filler, notice and prose, and the even background."""

    def __init__(self, counts: np.ndarray) -> None:
        p = counts / np.maximum(1.0, counts.sum(axis=1, keepdims=True))
        self.log = np.log(MIX * p + (1 - MIX) / SLOTS).astype(np.float32)
        self.even = np.float32(-np.log(SLOTS))

    def ratios(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every window of the lines: line, characters, mean log-likelihood ratio of filler and of notices against the better of prose and background."""
        flat, size = line_grams(lines)
        per = np.maximum((size + WINDOW // 2) // WINDOW, 1)
        per[size == 0] = 0
        line = np.repeat(np.arange(len(lines)), per)
        if not len(line):
            e = np.empty(0)
            return line, e, e, e
        rank = np.arange(len(line)) - np.repeat(np.cumsum(per) - per, per)
        starts = np.repeat(np.cumsum(size) - size, per) + rank * WINDOW
        n = np.diff(np.r_[starts, len(flat)])
        sums = [np.add.reduceat(x.take(flat), starts) / n for x in self.log]
        against = np.maximum(sums[2], self.even)
        return line, n, sums[0] - against, sums[1] - against


def seed_counts() -> np.ndarray:
    """(2, SLOTS): the n-grams of the wordings above, of filler and of notices."""
    counts = np.zeros((2, SLOTS))
    words_ = LATIN.split()
    latin = [" ".join(words_[i : i + 8]) for i in range(0, len(words_), 4)]
    for k, seeds in enumerate(([*latin, *FILLER_SEEDS.strip().split("\n")], NOTICE_SEEDS.strip().split("\n"))):
        for x in seeds:
            for part in _SENTENCE.split(x):
                np.add.at(counts[k], grams(part), 1)
    return counts


def line_counts(lines: list[str]) -> np.ndarray:
    return np.bincount(line_grams(lines)[0], minlength=SLOTS).astype(np.int64)


def line_means(lines: list[str], models: Models) -> tuple[np.ndarray, np.ndarray]:
    """((2, lines) mean ratios of filler and of notices, characters) of each line."""
    line, n, f, e = models.ratios(lines)
    total = np.bincount(line, n, len(lines))
    return np.stack([np.bincount(line, n * x, len(lines)) for x in (f, e)]) / np.maximum(total, 1), total


def near_lines(body: list[str], models: Models) -> list[str]:
    """The lines that the rounds of learning look at."""
    mean, _ = line_means(body, models)
    return [body[i] for i in np.flatnonzero(mean.max(axis=0) > NEAR)]


def moved(bodies: list[tuple[int, list[str]]], models: Models) -> np.ndarray:
    """(2, SLOTS): the n-grams of the lines that the models are sure of, from (n-grams of the main body, its near lines).

    Paragraphs of filler pass wherever they stand, notices only where they cover their main body.
    """
    out = np.zeros((2, SLOTS), np.int64)
    lines = [x for _, b in bodies for x in b]
    if not lines:
        return out
    page = np.repeat(np.arange(len(bodies)), [len(b) for _, b in bodies])
    mean, total = line_means(lines, models)
    what = np.where(mean.max(axis=0) > LIKELY, mean.argmax(axis=0), -1)
    cover = np.bincount(page, total * (what >= 0), len(bodies)) / np.maximum(1, [n for n, _ in bodies])
    words_ = np.array([x.count(" ") + 1 for x in lines])
    for k, ok in ((0, (words_ >= 6) | (cover[page] >= COVER)), (1, cover[page] >= COVER)):
        at = np.flatnonzero((what == k) & (total >= 12) & ok)
        if len(at):
            out[k] = line_counts([lines[i] for i in at])
    return out


def learned(seeds: np.ndarray, prose: np.ndarray, more: np.ndarray) -> Models:
    """The models when the n-grams `more` have passed from the prose to filler and notices; seeds and learned n-grams weigh the same."""
    weight = seeds.sum(axis=1, keepdims=True) / np.maximum(1, more.sum(axis=1, keepdims=True))
    return Models(np.maximum(np.concatenate([seeds + more * np.minimum(1.0, weight), [prose - more.sum(axis=0)]]), 0))


def placeholders(line: str) -> bool:
    """Whether the line holds an unfilled placeholder, sentences about placeholders aside."""
    if not _HINT.search(line) or not PLACEHOLDER.search(line):
        return False
    letters = sum(c.isalnum() or c.isspace() for c in line)
    if letters < 0.6 * len(line) and PLACEHOLDER.sub("", line).strip():
        return False  # character noise
    return any(PLACEHOLDER.search(s) and not about(s) for s in _SENTENCE.split(line))


def about(sentence: str) -> bool:
    """Whether a sentence speaks about templates: enough different words of that subject outside its placeholders."""
    found_ = {(a.lower(), b.lower()) for a, b in ABOUT.findall(PLACEHOLDER.sub(" ", sentence))}
    return sum(2 if a else 1 for a, _ in found_) >= ABOUT_LEAST


def residue(body: list[tuple[str, str]], models: Models) -> tuple[bool, int, int, int, int]:
    """(case, lines with placeholders, characters of filler, of notices, of main body) of the main-body lines (line, plain text)."""
    holes = sum(placeholders(x) for x, _ in body)
    texts = [t for _, t in body if _LETTER.search(t) and not _SERIAL.fullmatch(t)]
    line, n, f, e = models.ratios(texts)
    is_f, is_e = (f > WEAK) & (f >= e), (e > WEAK) & (e > f)
    total, filler, notice = int(n.sum()), int(n[is_f].sum()), int(n[is_e].sum())
    paragraph = False
    if filler:
        size, sure, weight = (np.bincount(line, w, len(texts)) for w in (n, n * (f > LIKELY), n * f))
        for i in np.flatnonzero((sure >= 0.6 * size) & (weight > SURE / 2 * size)):
            paragraph |= len(texts[i].split(" ")) >= 6
    case = holes > 0 or paragraph or (total > 0 and filler + notice >= COVER * total)
    return bool(case), int(holes), filler, notice, total


def split_body(main: str | None, plains: str | None, kinds: str | None) -> list[tuple[str, str, str]]:
    """(line, plain text, kind) of the lines of a main body."""
    return list(zip(main.split("\n"), plains.split("\n"), kinds)) if main is not None and kinds else []


def _texts(plains: str | None) -> list[str]:
    return [t for t in plains.split("\n") if _LETTER.search(t) and not _SERIAL.fullmatch(t)] if plains else []


def _sparse(counts: np.ndarray) -> pa.RecordBatch:
    what, slot = np.nonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(what.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[what, slot])], ["what", "slot", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((1, SLOTS), np.int64)
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            counts[0] += line_counts([t for m in b.column(2).slice(lo, 500).to_pylist() for t in _texts(m)])
    yield _sparse(counts)


def _total(parts: DataFrame, kinds: int) -> np.ndarray:
    """The sums of the counts of all partitions: at most kinds * SLOTS rows for the driver."""
    out = np.zeros((kinds, SLOTS), np.int64)
    for r in parts.groupBy("what", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.what, r.slot] = r.n
    return out


def learn(bodies: DataFrame) -> Models:
    """The models from all main bodies (page_id, main, plains, kinds); see the module's text."""
    sc = bodies.sparkSession.sparkContext
    counted = "what int, slot int, n bigint"
    seeds = seed_counts()
    prose = _total(bodies.mapInArrow(_count, counted), 1)[0]
    models = learned(seeds, prose, np.zeros((2, SLOTS), np.int64))
    first = sc.broadcast(models)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, lines = [], []
            for m in b.column(2).to_pylist():
                body = _texts(m)
                if body and (some := near_lines(body, first.value)):
                    total.append(int(line_grams(body)[1].sum()))
                    lines.append(some)
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array(lines, pa.list_(pa.string()))], ["total", "lines"])

    some = cut(bodies.mapInArrow(near, "total bigint, lines array<string>"))
    for _ in range(ROUNDS):
        now = sc.broadcast(models)

        def sure(batches: Iterator[pa.RecordBatch], now: Broadcast = now) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, SLOTS), np.int64)
            for b in batches:
                out += moved(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist())), now.value)
            yield _sparse(out)

        models = learned(seeds, prose, _total(some.mapInArrow(sure, counted), 2))
    return models


def prepare(pages: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The main bodies (page_id, main, plains, kinds), a written table, and the models that they give."""
    bodies = cut(p4_main_body.Modelled(pages).bodies())
    return bodies, pages.sparkSession.sparkContext.broadcast(learn(bodies))


def judged(pages: DataFrame) -> DataFrame:
    """(page_id, residue, holes, filler, notice, body) of every page."""
    bodies, models = prepare(pages)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [residue([(x, t) for x, t, _ in split_body(*m)], models.value) for m in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.bool_()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["page_id", "residue", "holes", "filler", "notice", "body"])

    return bodies.mapInArrow(judge, "page_id bigint, residue boolean, holes bigint, filler bigint, notice bigint, body bigint")


def found(pages: DataFrame) -> DataFrame:
    return judged(pages).filter("residue").select("page_id")


def report(pages: DataFrame) -> DataFrame:
    """(page_id, holes, filler, notice, body) of every page: what was localised, in lines and characters."""
    return judged(pages).select("page_id", "holes", "filler", "notice", "body")
