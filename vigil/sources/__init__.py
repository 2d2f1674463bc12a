"""Readers: text lines (file, socket, Kafka), binary image records, labelled image folders."""
