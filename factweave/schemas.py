"""Record types and the fixed values of the decomposition format."""

from __future__ import annotations

from pyspark.sql import types as T

# Results depend on them letter by letter.
FACT_SEP = " <FACT-SEP> "
LABELS = ("FACT", "Question")
STOP = "sentence:"
SENTENCE_HEAD = "sentence:\n"
DECOMPOSE_HEAD = "\ndecompose:"
SLOT = "[Input Sentence]"
DECODER_MARKS = ("</s>", "<pad>")
ARTICLES = ("a", "an", "the")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
INPUT_PAD = 0
LABEL_PAD = -100
GENERATION_MARGIN = 64
LENGTH_SLICES = ((0, 3), (4, 4), (5, 5), (6, 100))
METRICS = ("f1", "em", "bleu1", "bleu2", "bleu3", "bleu4")

PARAPHRASE_RESULT = T.StructType(
    [
        T.StructField("paraphrase", T.StringType()),
        T.StructField("sub_sentences", T.ArrayType(T.StringType())),
    ]
)

# One question record. `ord` is its place in the corpus: unique, not always dense.
# A missing entry is NULL. Sub-sentences which came as one text are in the `_text` column.
QUESTIONS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("synthesis_question", T.StringType()),
        T.StructField("nature_question", T.StringType()),
        T.StructField("program", T.StringType()),
        T.StructField("synthesis_question_paraphrases", T.ArrayType(T.StringType())),
        T.StructField("synthesis_question_sub_sentences", T.ArrayType(T.StringType())),
        T.StructField("nature_question_sub_sentences", T.ArrayType(T.StringType())),
        T.StructField("nature_question_sub_sentences_text", T.StringType()),
        T.StructField(
            "synthesis_question_paraphrases_sub_sentences", T.ArrayType(PARAPHRASE_RESULT)
        ),
    ]
)
