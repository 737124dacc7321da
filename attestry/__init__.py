"""Attestry: fact extraction and cross-document verification as Spark DataFrame operators."""
