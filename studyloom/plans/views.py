"""Input views: the driver tables in the shape of the learning entities.

Plain SQL that Spark and the checking engine read alike. ``<name>`` stands for
a table or another view.
"""

_TOPIC = "concat('topic_', CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 12 AS VARCHAR(9)))"
_QNO = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 10 + 1"

VIEWS = {
    "fx_activity": """
SELECT event_id AS activity_id, user_id, ts,
  CASE event_type WHEN 'signup' THEN 'course_generation' WHEN 'view' THEN 'course_save' WHEN 'click' THEN 'exercise_completion' ELSE 'quiz_completion' END AS activity_type,
  CASE WHEN event_type = 'click' AND value >= 100 THEN 'advanced' WHEN event_type = 'click' THEN 'beginner' END AS difficulty,
  CASE WHEN event_type = 'purchase' THEN least(value, 100.0) END AS score
FROM <events> e WHERE event_type <> 'error'""",
    "fx_sessions": f"""
SELECT event_id AS id, user_id, {_TOPIC} AS topic,
  CASE event_type WHEN 'purchase' THEN 'quiz' WHEN 'view' THEN 'course_generation' ELSE 'chat' END AS activity_type,
  ts AS start_time, CAST(floor(value * 60) AS INT) AS duration_seconds,
  CASE WHEN event_type = 'purchase' AND value > 5 THEN least(value, 100.0) WHEN event_type = 'purchase' THEN 0.0 END AS score
FROM <events> e""",
    "fx_mistakes": f"""
SELECT event_id AS id, user_id, {_TOPIC} AS topic,
  'quiz_wrong_answer' AS mistake_type, concat('question ', CAST(event_id AS VARCHAR(20))) AS question, 'A' AS user_answer, 'B' AS correct_answer,
  ts AS timestamp, event_id % 5 = 0 AS reviewed
FROM <events> e WHERE event_type = 'error'""",
    "fx_exercises": """
SELECT p_partkey AS id, p_name AS title, concat('Practise ', p_brand) AS description,
  CASE WHEN p_size <= 16 THEN 'beginner' WHEN p_size <= 33 THEN 'intermediate' ELSE 'advanced' END AS difficulty,
  p_type AS topic, p_size % 10 <> 0 AS is_active, p_partkey % 97 AS created_by,
  DATE '2024-01-01' + CAST(p_partkey % 300 AS INT) AS created_at
FROM <part> p""",
    "fx_submissions": """
SELECT l.l_partkey AS exercise_id, o.o_custkey AS user_id,
  CASE l.l_returnflag WHEN 'A' THEN 'success' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status,
  l.l_quantity / 10 AS execution_time, l.l_shipdate AS submitted_at
FROM <lineitem> l JOIN <orders> o ON l.l_orderkey = o.o_orderkey""",
    "fx_attempts": """
SELECT o_orderkey AS id, o_orderkey % 150 AS exercise_id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status,
  floor(o_totalprice / 1000) / 10 AS execution_time, o_orderdate AS submitted_at
FROM <orders> o""",
    "fx_progress": """
SELECT min(id) AS id, user_id, exercise_id, max(CASE WHEN status = 'success' THEN 1 ELSE 0 END) = 1 AS is_completed,
  count(*) AS attempts_count, min(submitted_at) AS first_attempt_at
FROM <fx_attempts> a GROUP BY user_id, exercise_id""",
    "fx_answers": f"""
SELECT room_id, user_id, question_number, selected_answer, response_time, answered_at FROM (
  SELECT user_id % 10 AS room_id, user_id, {_QNO} AS question_number,
    CAST(event_id % 5 AS INT) - 1 AS selected_answer, value AS response_time, ts AS answered_at,
    row_number() OVER (PARTITION BY user_id, {_QNO} ORDER BY ts, event_id) AS rn
  FROM <events> e) t WHERE rn = 1""",
    "fx_answer_log": f"""
SELECT event_id AS id, user_id % 10 AS room_id, user_id, {_QNO} AS question_number,
  CAST(event_id % 5 AS INT) - 1 AS selected_answer, value AS response_time, ts
FROM <events> e""",
    "fx_questions": f"""
SELECT room_id, question_number, CAST((room_id + question_number) % 4 AS INT) AS correct_answer
FROM (SELECT DISTINCT user_id % 10 AS room_id, {_QNO} AS question_number FROM <events> e) q""",
    "fx_participants": """
SELECT user_id % 10 AS room_id, user_id, min(ts) AS joined_at, max(event_id) % 7 <> 0 AS is_active FROM <events> e GROUP BY user_id""",
    "fx_rooms": """
SELECT user_id % 10 AS id, concat('R', CAST(user_id % 10 AS VARCHAR(9))) AS code, min(user_id) AS host_id,
  concat('topic ', CAST(user_id % 10 AS VARCHAR(9))) AS topic, 10 AS num_questions,
  CASE WHEN min(user_id) % 2 = 0 THEN 20 ELSE 5 END AS max_players,
  CASE min(user_id) % 4 WHEN 0 THEN 'waiting' WHEN 1 THEN 'starting' WHEN 2 THEN 'in_progress' ELSE 'finished' END AS status,
  CAST(min(user_id) % 10 AS INT) + 1 AS current_question, min(ts) AS created_at
FROM <events> e GROUP BY user_id % 10""",
    "fx_users": """
SELECT c_custkey AS id, c_name AS username, concat(lower(c_name), '@Mail.test') AS email,
  CASE WHEN c_nationkey % 3 = 0 THEN 'en' WHEN c_nationkey % 3 = 1 THEN 'fr' END AS language_preference,
  CAST(greatest(floor(c_acctbal * 5), 0) AS INT) AS xp,
  CAST(c_custkey % 23 AS INT) AS total_courses_completed, CAST(c_custkey % 31 AS INT) AS total_quizzes_completed,
  CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE CAST(c_custkey % 5000 AS INT) END AS total_study_time_minutes
FROM <customer> c""",
    "fx_courses": """
SELECT doc_id AS id, concat('# Course ', CAST(doc_id AS VARCHAR(20)), chr(10), text) AS content, lang AS topic, source AS module,
  doc_id % 50 AS created_by, concat('Stored title of course number ', CAST(doc_id AS VARCHAR(20))) AS title,
  DATE '2024-01-01' + CAST(doc_id % 200 AS INT) AS created_at
FROM <documents> d""",
    "fx_quiz_text": """
SELECT p_partkey AS quiz_id, concat('intro', chr(10), 'Q1. What is ', p_name, '?', chr(10), 'A. ', p_brand, chr(10), 'B. ', p_type, chr(10), chr(10),
  CASE WHEN p_size % 10 = 0 THEN 'no key' WHEN p_size % 2 = 0 THEN 'Answer: b' ELSE 'Answer: A' END, chr(10), 'Explanation: size ', CAST(p_size AS VARCHAR(9)),
  CASE WHEN p_size % 3 = 0 THEN concat(chr(10), 'Q2. Second', chr(10), 'line two ', p_brand, chr(10), 'A. yes', chr(10), 'B. no', chr(10), 'C. maybe', chr(10), 'D. never',
    chr(10), 'Réponse: ', CASE WHEN p_size % 4 = 0 THEN 'E' WHEN p_size % 4 = 1 THEN 'BC' ELSE 'd' END, chr(10), 'Explication: ', p_type) ELSE '' END) AS text,
  CASE WHEN p_size % 5 = 0 THEN 'fr' WHEN p_size % 5 = 1 THEN 'de' ELSE 'en' END AS language, p_type AS topic
FROM <part> p""",
    "fx_index": """
SELECT CASE WHEN source = 'src0' THEN 'ressources' ELSE concat('01_', source) END AS module, concat('intro_to_', lang) AS section,
  CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS INT) AS section_pos,
  concat(CASE WHEN doc_id % 3 = 0 THEN 'draft' ELSE 'doc' END, CAST(doc_id AS VARCHAR(20)), '.md') AS file, doc_id AS file_pos
FROM <documents> d""",
    "fx_files": """
SELECT doc_id AS id, concat('/data/', parent, '/', name) AS path, name, parent, 'md' AS type FROM (
  SELECT doc_id, concat(CASE WHEN doc_id % 10 = 0 THEN concat(source, '__') ELSE '' END, 'doc', CAST(doc_id AS VARCHAR(20)), '.md') AS name,
    CASE WHEN doc_id % 5 = 0 THEN 'resources' WHEN doc_id % 5 = 1 THEN lang WHEN source = 'src0' THEN 'ressources' ELSE concat('01_', source) END AS parent
  FROM <documents> d) t""",
    "fx_pages": """
SELECT concat('/data/courses/', source, '.tar.md') AS path, doc_id AS page, text FROM <documents> d""",
    "fx_markdown": """
SELECT doc_id AS id, concat('# Title ', CAST(doc_id AS VARCHAR(20)), chr(10), 'It starts.', chr(10), '## Part ', lang, chr(10), '```python', chr(10), '# not a heading', chr(10), 'print(', CAST(doc_id AS VARCHAR(20)), ')', chr(10), '```', chr(10),
  '- first ', lang, chr(10), '* second', chr(10), '1. step one', chr(10), '2. step two', chr(10), chr(10), '| a | b ||', chr(10), '| --- | :-: |', chr(10), '| ', source, ' | 2 |', chr(10), '| x | ', lang, ' |', chr(10), chr(10),
  '###### six', chr(10), '##### five', chr(10), '```', chr(10), 'plain', chr(10), '```', chr(10), text) AS text
FROM <documents> d""",
    "fx_vectors": """
SELECT vec_id AS id, embedding AS vector, label FROM <embeddings> e""",
    "fx_exercise_text": """
SELECT p_partkey AS id, p_type AS topic, CASE p_partkey % 9
  WHEN 0 THEN concat('Here:', chr(10), '```json', chr(10), '{"title": "', p_name, '", "description": "one', chr(10), 'two', chr(10), 'three", "starter_code": "def f():', chr(10), chr(9), 'pass", "solution": "x", "tests": [{"input": "f(1)", "expected": "', p_brand, '"}]}', chr(10), '```', chr(10), 'bye')
  WHEN 1 THEN concat('Sure {"title": "', p_name, '", "description": "d", "starter_code": "a", "solution": "b", "tests": []} done')
  WHEN 2 THEN concat('{"title": "', p_name, '", "description": "', p_brand, '", "solution": "return 1", "tests": [{"input": "g()", "expected": "2"}]}')
  WHEN 3 THEN concat('no json here about ', p_name)
  WHEN 4 THEN concat('{"title": "', p_name, '", "description": "x", "starter_code": ', repeat(chr(34), 3), 'def h():', chr(10), '  pass', repeat(chr(34), 3), ', "solution": ', repeat(chr(34), 3), 's', repeat(chr(34), 3), ', "tests": [{"input": "h()", "expected": "3"}, {"input": "h(1)", "expected": "4"}]}')
  WHEN 5 THEN concat('```json', chr(10), '{"title": "', p_name, '", "description": "x", "starter_code": "u", "solution": "v", "tests": [1, 2]}')
  WHEN 6 THEN concat('{"title": "cut off ', p_name, '", "description": "x", "starter_code": "u"')
  WHEN 7 THEN concat('{"title": "', p_name, '"} and {"description": "', p_type, '"}')
  ELSE concat('"title": "no braces ', p_name, '"') END AS text
FROM <part> p""",
    "fx_code": """
SELECT p_partkey AS id, concat(CASE p_size % 8 WHEN 0 THEN 'import os, time' WHEN 1 THEN '  import os' WHEN 2 THEN 'from subprocess import run' WHEN 3 THEN 'x = profile(1)'
  WHEN 4 THEN 'importos' WHEN 5 THEN 'import glob, pickle' WHEN 6 THEN 'eval("1")' ELSE 'y = 2' END, chr(10), '# ', p_name, chr(10), 'def f(a):', chr(10), '    return a') AS code
FROM <part> p""",
    "fx_runs": """
SELECT o_orderkey AS id, o_orderkey % 7 < 4 AS success,
  CASE o_orderkey % 7 WHEN 0 THEN concat('None', chr(10), ' 5 ', chr(10)) WHEN 1 THEN concat(chr(10), '  ', o_orderstatus, '  ') WHEN 2 THEN ' None ' WHEN 3 THEN '5' ELSE '' END AS output,
  CASE WHEN o_orderkey % 7 >= 4 THEN concat('Execution error: ', o_orderstatus) ELSE '' END AS error,
  CASE o_orderkey % 7 WHEN 4 THEN 'ValueError' WHEN 5 THEN 'KeyError' WHEN 6 THEN 'TypeError' END AS exception_type,
  CASE o_orderkey % 5 WHEN 0 THEN '5' WHEN 1 THEN ' Exception ' WHEN 2 THEN 'raises ValueError' WHEN 3 THEN o_orderstatus ELSE 'None' END AS expected
FROM <orders> o""",
}
