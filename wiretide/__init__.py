"""Packet-forensics analytics on PySpark."""
