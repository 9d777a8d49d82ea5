"""A conversation over a library: follow-ups, few elements filled up with chunks, a window of messages, commands."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from .api import Library
from .functions import text
from .functions.format import indexes_of
from .functions.vectors import score_percent
from .operators import rag, search
from .operators.providers import with_retries

SYSTEM = "Answer from the numbered context only, in a few paragraphs, and cite it like [1]. Say so if it holds no answer."


@dataclass
class Chat:
    library: Library
    messages: list[dict] = field(default_factory=list)
    results: list[dict] = field(default_factory=list)
    last_query: str = ""

    def window(self) -> list[dict]:
        """What the model is shown: the instruction and the last ten turns."""
        return [{"role": "system", "content": SYSTEM}, *self.messages[-rag.MESSAGES :]]

    def _value(self, column, *values):
        frame = self.library.corpus.documents.sparkSession.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
        return frame.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]

    def ask(self, question: str) -> str:
        """The model's answer. Elements come first; under four of them, up to four chunks follow. The question as it was asked is the next one's context."""
        query = self._value(text.expand_followup, question, self.last_query)
        corpus, embed = self.library.corpus, self.library._embed
        elements = search.search_elements(corpus, query, embed, rag.ELEMENTS)
        chunks = search.search(corpus, query, embed, rag.ELEMENTS)
        found = rag.chat_results(elements, chunks).withColumn("percent", score_percent(F.col("score")))
        rows = found.orderBy("rank").collect()
        self.results, self.last_query = [r.asDict() for r in rows], question
        context = ""
        if rows:
            context = rag.context(found.sparkSession.createDataFrame(rows, found.schema)).first()["text"]
        self.messages.append({"role": "user", "content": f"Context:\n{context}\n\nQuestion: {question}"})
        prompt = "\n\n".join(f"{m['role']}: {m['content']}" for m in self.window())
        answer = with_retries(lambda: self.library.generator(prompt), tries=1) if self.library.generator else None
        answer = self._value(text.strip_think_tags, answer) if answer else "Error querying LLM"
        self.messages.append({"role": "assistant", "content": answer})
        return answer

    def show(self, places: str) -> list[dict]:
        """Results by a list like ``1,2``; places that do not exist are left out."""
        return [self.results[i] for i in indexes_of(places) if 0 <= i < len(self.results)]

    def sources(self) -> str:
        if not self.results:
            return "No sources available."
        return "\n".join(f"[{i}] {(r['element_type'] or 'text').upper()}: {r['element_label'] or ''} | {r['document_title']} p.{r['page_number']} | {r['percent']:.0f}%" for i, r in enumerate(self.results, 1))

    def clear(self) -> None:
        self.messages, self.results, self.last_query = [], [], ""
