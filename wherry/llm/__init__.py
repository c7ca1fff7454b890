"""Operators that prepare text, vectors and conversations for training models. Nothing outside this folder imports it."""
