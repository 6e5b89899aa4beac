"""Cairnlake: document, record and corpus analytics declared as Spark plans."""
