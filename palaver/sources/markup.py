"""Per-page helper of the extraction job: HTML text → raw message records.

It reports what the markup says and leaves all interpretation (numbers, times,
text rules) to Spark expressions. A page is kept as a flat list of nodes in
document order; a node's subtree is the slice up to its ``end``.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa

# --- fixed values -----------------------------------------------------------
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input "
    "isindex keygen link menuitem meta nextid param source spacer track wbr".split()
)
# Text inside these belongs to no surrounding text.
HIDDEN_TAGS = frozenset("script style template rt rp".split())
NOISE_TAGS = frozenset("script table blockquote button".split())
BLANKS = " \n\t\f\r"
BLANK_KEEPING_TAGS = ("pre", "textarea")
MEDIA_NOTE = "Ansehen auf"
EMOJI_TEXT = "."
NO_HTML, BROKEN_MARKUP = "no html", "broken markup"
# ----------------------------------------------------------------------------


class Node:
    __slots__ = ("tag", "attrs", "classes", "text", "end")

    def __init__(self, tag, attrs, text):
        self.tag = tag
        self.attrs = attrs
        self.classes = attrs["class"].split() if attrs and "class" in attrs else ()
        self.text = text
        self.end = 0

    def has(self, tag, token):
        return self.tag == tag and token in self.classes


class PageNodes(HTMLParser):
    """Builds the node list. An end tag closes the nearest open tag of its name;
    without one it is ignored. Void tags never stay open. Text that is all blanks
    shrinks to one line break, or else to one blank."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = []
        self._open = []
        self._counts = {}
        self._hidden = 0
        self._text = []
        self.cut = frozenset()

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers; counting them takes time

    def handle_starttag(self, tag, attrs):
        self._end_text()
        # An attribute without a value is there, and empty.
        self.nodes.append(Node(tag, {k: v or "" for k, v in attrs}, None))
        if tag in VOID_TAGS:
            self.nodes[-1].end = len(self.nodes)
            return
        self._open.append(len(self.nodes) - 1)
        self._counts[tag] = self._counts.get(tag, 0) + 1
        self._hidden += tag in HIDDEN_TAGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close_last()

    def handle_endtag(self, tag):
        self._end_text()
        if self._counts.get(tag):
            while self._close_last() != tag:
                pass

    def handle_data(self, data):
        self._text.append(data)

    def handle_comment(self, data):
        self._end_text()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def _end_text(self):
        if not self._text:
            return
        text = "".join(self._text)
        self._text.clear()
        if self._hidden:
            return
        if not text.strip(BLANKS) and not any(map(self._counts.get, BLANK_KEEPING_TAGS)):
            text = "\n" if "\n" in text else " "
        self.nodes.append(Node(None, None, text))
        self.nodes[-1].end = len(self.nodes)

    def _close_last(self):
        node = self.nodes[self._open.pop()]
        node.end = len(self.nodes)
        self._counts[node.tag] -= 1
        self._hidden -= node.tag in HIDDEN_TAGS
        return node.tag

    def finish(self, html):
        """Read a whole page; True if the tokenizer gave up on the way. What came before stays,
        and ``cut`` holds the numbers of the nodes that were open there."""
        stopped = False
        try:
            self.feed(html)
            self.close()
        except AssertionError:
            stopped, self.cut = True, frozenset(self._open)
        self._end_text()
        while self._open:
            self._close_last()
        return stopped


def _stripped_text(nodes, start, skip_tag=None):
    """Text of a subtree, each piece stripped, optionally without some tags."""
    pieces, i, end = [], start + 1, nodes[start].end
    while i < end:
        if nodes[i].text is not None:
            pieces.append(nodes[i].text.strip())
        elif nodes[i].tag == skip_tag:
            i = nodes[i].end
            continue
        i += 1
    return "".join(pieces)


def _is_media_note(nodes, start):
    """Is the text of this subtree the note? Stops at the first other letter, as
    unclosed paragraphs nest and each would otherwise be read to the page's end."""
    text = ""
    for i in range(start + 1, nodes[start].end):
        text += (nodes[i].text or "").strip()
        if not MEDIA_NOTE.startswith(text):
            return False
    return text == MEDIA_NOTE


def _is_noise(nodes, i):
    node = nodes[i]
    return (
        node.tag in NOISE_TAGS
        or node.has("div", "message-lastEdit")
        or (node.tag == "p" and _is_media_note(nodes, i))
    )


def _visible(nodes, start, end):
    """Indexes of the subtree's nodes outside of noise."""
    i = start
    while i < end:
        if nodes[i].text is None and _is_noise(nodes, i):
            i = nodes[i].end
        else:
            yield i
            i += 1


def _message(nodes, start):
    end = nodes[start].end
    inside = [(i, nodes[i]) for i in range(start + 1, end) if nodes[i].text is None]
    users = [n.attrs.get("data-user-id") for _, n in inside if n.has("a", "username")]
    items = [i for i, n in inside if n.tag == "li"]
    times = [n.attrs.get("datetime") for _, n in inside if n.has("time", "u-dt")]
    likes = [i for i, n in inside if n.has("a", "reactionsBar-link")]
    body = [i for i, n in inside if n.has("div", "message-content")]
    quotes = [n for _, n in inside if n.has("blockquote", "bbCodeBlock--quote")]
    liked = range(likes[0] + 1, nodes[likes[0]].end) if likes else ()
    content_end = nodes[body[0]].end if body else 0
    emojis, content = [], []
    for i in _visible(nodes, start + 1, end):
        in_content = body and body[0] < i < content_end
        if nodes[i].text is not None:
            if in_content:
                content.append(nodes[i].text)
        elif nodes[i].has("img", "smilie"):
            emojis.append(nodes[i].attrs.get("data-shortname"))
            if in_content:
                content.append(EMOJI_TEXT)
    return {
        "data_author": nodes[start].attrs.get("data-author"),
        "data_content": nodes[start].attrs.get("data-content"),
        "fourth_item": _stripped_text(nodes, items[3]) if len(items) > 3 else None,
        "user_ids": users,
        "datetime": times[0] if times else None,
        "liking_names": sum(nodes[i].tag == "bdi" for i in liked),
        "likes_text": _stripped_text(nodes, likes[0], "bdi") if likes else None,
        "quotes": [n.attrs.get("data-quote") for n in quotes],
        "spoilers": sum(n.has("div", "bbCodeSpoiler") for _, n in inside),
        "is_edited": any(n.has("div", "message-lastEdit") for _, n in inside),
        "emojis": emojis,
        "raw_content": "".join(content) if body else None,
    }


def messages_of(html):
    """Raw record of every message on a page, in page order, and what is wrong with the page, or None."""
    if html is None:
        return [], NO_HTML
    page = PageNodes()
    problem = BROKEN_MARKUP if page.finish(html) else None
    messages = [
        {**_message(page.nodes, i), "is_cut": i in page.cut}
        for i, node in enumerate(page.nodes)
        if node.text is None and node.has("article", "message")
    ]
    return messages, problem


def outline_of(html):
    """Text, links and paragraphs of any page, noise left out."""
    page = PageNodes()
    page.finish(html)
    nodes = page.nodes
    seen = [nodes[i] for i in _visible(nodes, 0, len(nodes))]
    return {
        "text": "".join(n.text for n in seen if n.text is not None),
        "links": sum(n.tag == "a" for n in seen),
        "paragraphs": sum(n.tag == "p" for n in seen),
    }


def message_batches(page_names, schema, batch_rows):
    """Arrow function: batches of pages → batches of message records, and a record for each page."""

    def parse(batches):
        pending = []
        for batch in batches:
            html = batch.column("html")
            head = batch.select(page_names).to_pylist()
            for row, page in enumerate(head):
                found, problem = messages_of(html[row].as_py())
                pending.extend({**page, **message} for message in found)
                pending.append({**page, "page_messages": len(found), "page_problem": problem})
                while len(pending) >= batch_rows:
                    yield pa.RecordBatch.from_pylist(pending[:batch_rows], schema)
                    del pending[:batch_rows]
        if pending:
            yield pa.RecordBatch.from_pylist(pending, schema)

    return parse


def outline_batches(schema):
    """Arrow function: batches of (page_id, html) → batches of outlines."""

    def parse(batches):
        for batch in batches:
            ids, html = batch.column("page_id"), batch.column("html")
            rows = [
                {"page_id": ids[i].as_py(), **outline_of(html[i].as_py() or "")}
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return parse
