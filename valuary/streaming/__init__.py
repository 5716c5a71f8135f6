"""Streaming forms of the valuary library."""
