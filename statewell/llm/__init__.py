"""Training-data operators: deduplication, media, language, WARC, tokens, leaks, licences.

Nothing outside this folder imports it; ``queries`` lists what is registered.
"""
