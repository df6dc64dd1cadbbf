"""Declared schemas (as DDL) of the learning entities and of the JSON they carry."""

from __future__ import annotations

TEST = "struct<input: string, expected: string>"
TEST_RESULT = (
    "struct<test_number: int, input: string, expected: string, actual: string, passed: boolean, error: string>"
)
QUESTION = "struct<question: string, options: array<string>, correct_answer: int, explanation: string>"

ANSWER_MESSAGE = "type string, answer int, response_time double"
SUBMISSION_PAYLOAD = "code string"
CHAT_PAYLOAD = "message string"
QUIZ_PAYLOAD = f"questions array<{QUESTION}>, topic string, language string, session_id bigint"
QUIZ_SUBMISSION_PAYLOAD = f"session_id bigint, answers array<int>, quiz_data struct<questions: array<{QUESTION}>>"

ENTITIES = {
    "users": """id bigint, email string, username string, role string, bio string, language_preference string,
        xp int, total_courses_completed int, total_quizzes_completed int, total_study_time_minutes int,
        current_streak int, last_activity_date date""",
    "exercises": f"""id bigint, title string, description string, difficulty string, topic string,
        starter_code string, solution string, tests array<{TEST}>, created_by bigint, created_at timestamp_ntz,
        updated_at timestamp_ntz, is_active boolean, attempts_count int, success_count int""",
    "submissions": f"""id bigint, exercise_id bigint, user_id bigint, submitted_code string, status string,
        execution_output string, error_message string, execution_time double,
        test_results array<{TEST_RESULT}>, submitted_at timestamp_ntz, ip_address string""",
    "exercise_progress": """id bigint, user_id bigint, exercise_id bigint, is_completed boolean,
        best_submission bigint, attempts_count int, first_attempt_at timestamp_ntz, completed_at timestamp_ntz""",
    "rooms": """id bigint, code string, host_id bigint, topic string, num_questions int, max_players int,
        status string, current_question int, question_start_time timestamp_ntz, created_at timestamp_ntz,
        started_at timestamp_ntz, finished_at timestamp_ntz""",
    "participants": """id bigint, room_id bigint, user_id bigint, score int, correct_answers int,
        is_active boolean, joined_at timestamp_ntz""",
    "questions": """id bigint, room_id bigint, question_number int, question_text string,
        options array<string>, correct_answer int, explanation string""",
    "answers": """id bigint, room_id bigint, user_id bigint, question_number int, selected_answer int,
        response_time double, points_earned int, answered_at timestamp_ntz""",
    "courses": """id bigint, title string, topic string, module string, content string,
        sources array<string>, created_by bigint, created_at timestamp_ntz, updated_at timestamp_ntz,
        is_favorite boolean, view_count int, completion_rate double""",
    "course_sections": """id bigint, course_id bigint, title string, content string, `order` int, section_type string""",
    "learning_sessions": """id bigint, user_id bigint, topic string, activity_type string,
        start_time timestamp_ntz, end_time timestamp_ntz, duration_seconds int, score double,
        metadata map<string, string>""",
    "mistakes": """id bigint, user_id bigint, topic string, mistake_type string, question string,
        user_answer string, correct_answer string, timestamp timestamp_ntz, reviewed boolean""",
    "chunks": """id string, document string, source string, type string, section string, embedding array<float>""",
}

# What choice columns may hold.
CHOICES = {
    ("users", "role"): ["student", "admin"],
    ("users", "language_preference"): ["en", "fr"],
    ("exercises", "difficulty"): ["beginner", "intermediate", "advanced"],
    ("submissions", "status"): ["pending", "success", "failed", "error", "timeout"],
    ("rooms", "status"): ["waiting", "starting", "in_progress", "finished"],
    ("course_sections", "section_type"): ["introduction", "explanation", "examples", "summary", "advanced"],
}
