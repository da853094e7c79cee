"""Inline sources in TypeScript, TSX, Rust and Python that the rule queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PANEL = '''
export function {name}({{ title, items, onPick, a, b, c, d, e, f }}) {{
  const [open, setOpen] = useState(false);
  const [rows, setRows] = useState([]);
  useEffect(() => {{ setRows(items); }}, [items]);
  function {name}Row({{ label }}) {{ return <li>{{label}}</li>; }}
  fetch("/api");
  return (
    <section>
      <Head title={{title}} />
      <Body title={{title}} />
      <Foot title={{title}} />
      <div><ul><li><b><i><u>deep</u></i></b></li></ul></div>
      <Store.Provider value={{{{ a, b, c, d, e, f, open }}}}>
        {{items.map((item, index) => <Row key={{index}} item={{item}} />)}}
        {{rows.map((row) => <Row item={{row}} />)}}
      </Store.Provider>
    </section>
  );
}}
'''

TOOLS = '''
export const double = (x: number) => { return x * 2; };
export const wrap = (x: number) => { return { x }; };
function grown(age: number) {
  if (age > 17) {
    return true;
  }
  return false;
}
function pick(a, b, c, d, e, f, g) {
  if (a && b || c && d) {
    if (e) {
      log("if (x) { }"); // if (y) { return true; } else { }
    }
    log(a);
    log(b);
  }
  if (f) { return 1; } else { return 2; }
}
const Tidy = () => <><p>one</p></>;
'''

SHAPES = '''
enum Shape { Dot, Wide(u8, u8, u8, u8, u8, u8, u8), Named { a: u8, b: Vec<u8> } }
fn from_text(text: &str) -> Result<Item, Error> {
    let parts: Vec<&str> = text.split(',').collect();
    let name = parts.first().map(|p| p.trim().to_string());
    let size = parts.get(1).map(|p| p.parse::<u32>().unwrap()).unwrap();
    Ok(Item { name: name.unwrap(), size: size + 1, kind: Kind::Plain, note: None, place: 0, depth: 1, rest: vec![] })
}
fn from_line(line: &str) -> Result<Item, Error> {
    let fields: Vec<&str> = line.split(',').collect();
    let title = fields.first().map(|p| p.trim().to_string());
    let count = fields.get(1).map(|p| p.parse::<u32>().unwrap()).unwrap();
    Ok(Item { name: title.unwrap(), size: count + 1, kind: Kind::Plain, note: None, place: 0, depth: 1, rest: vec![] })
}
impl Check for Left {
    fn check(&self, a: u8, b: u8, c: u8, d: u8, e: u8, f: u8, g: u8) -> Result<u8, Error> {
        let first = read(a).map_err(|e| Error::Read(e))?;
        let second = read(b).map_err(|e| Error::Read(e))?;
        if first > 10 {
            return Err(Error::Big);
        }
        if second > 10 {
            return Err(Error::Big);
        }
        Ok(first + second)
    }
}
impl Check for Right {
    fn check(&self, a: u8, b: u8, c: u8, d: u8, e: u8, f: u8, g: u8) -> Result<u8, Error> {
        let one = read(a).map_err(|e| Error::Read(e))?;
        let two = read(b).map_err(|e| Error::Read(e))?;
        if one > 10 {
            return Err(Error::Big);
        }
        if two > 10 {
            return Err(Error::Big);
        }
        Ok(one + two)
    }
}
fn is_big(x: u8) -> bool { if x > 3 { true } else { false } }
fn open(path: &str) -> File { File::open(path).expect("failed") }
fn first(value: Result<u8, Error>) -> u8 { match value { Ok(found) => found, Err(_) => 0 } }
fn second(other: Result<u8, Error>) -> u8 { match other { Ok(found) => found, Err(_) => 0 } }
fn deep(v: u8) -> u8 { match v { 0 => match v { 1 => match v { 2 => match v { 3 => match v { 4 => match v { _ => compute(4) }, _ => 0 }, _ => 1 }, _ => 2 }, _ => 3 }, 9 => compute(5), _ => compute(5) } }
'''

ROUTES = [("app/orders.py", '''
@router.post("/orders")
def create_order(user=Depends(current_user)):
    for line in load(user):
        if line.ready:
            db.add(line)
            requests.post(line.url)
    return first(second(third(fourth(user))))

@router.delete("/orders/{order_id}")
def drop_order(order_id, user=Depends(current_user)):
    return {}

@router.get("/orders/{name}/lines", response_model=Lines)
def lines(name, user=Depends(current_user)):
    a = load(name)
    b = clean(a)
    c = sort(b)
    return c

@router.get("/orders/latest/{part}", response_model=Lines)
def parts(part, user=Depends(current_user)):
    x = load(part)
    y = clean(x)
    z = sort(y)
    return z

class Item(BaseModel):
    name: str
    size: int
    kind: str

class Thing(BaseModel):
    kind: str
    size: int
    name: str

class ItemOut(BaseModel):
    kind: str
    size: int
    name: str
''')]  # fmt: skip

FILES = [("web/left.tsx", "tsx", PANEL.format(name="Left")), ("web/right.tsx", "tsx", PANEL.format(name="Right")), ("web/tools.tsx", "tsx", TOOLS), ("src/shapes.rs", "rust", SHAPES), ("app/orders.py", "python", "def f(a):\n    if a:\n        return 1\n    else:\n        return 2\n"), ("empty.rs", "rust", ""), ("null.rs", "rust", None), ("odd.tsx", "tsx", "if (x { ) } ] => {")]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, language string, source string")
