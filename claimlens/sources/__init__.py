"""Readers and writers: test-data fixtures, client files, audit logs, report sinks."""
