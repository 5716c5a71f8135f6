"""Readers and sinks of the valuary library."""
