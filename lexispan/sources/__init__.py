"""Readers and writers of source files, plans, batches, backups and fact tables."""
