"""Runnable jobs. Each module has a function that takes a session, and a command line that creates one."""

from __future__ import annotations

from jobs import answer_questions, refresh_windows


def queries() -> dict:
    return {"job1_refresh_windows": refresh_windows.query, "job2_answer_questions": answer_questions.query}


def oracle_sql() -> dict:
    return {"job1_refresh_windows": refresh_windows.SQL, "job2_answer_questions": answer_questions.SQL}
