"""Rows read out of semi-structured text: menu payloads and menu pages."""
