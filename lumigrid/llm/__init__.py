"""Training-data operators: ten corpus operators, their queries and the corpus pipeline's stages.

Nothing outside this subpackage imports it.
"""
