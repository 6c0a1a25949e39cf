"""Training-data operators: secrets, benchmark leaks, toxicity, licences,
SentencePiece coding, near duplicates, quality, language, quality rules, WARC
derivatives. Nothing outside this subpackage imports it."""
